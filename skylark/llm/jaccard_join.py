"""Exact Jaccard join of word-shingle sets in metric space.

Jaccard distance is a metric, but documents without a common shingle are all at distance 1, where pivots cannot tell
them apart. So pivots are chosen where distances mean something:

1. Equal sets become one node. Nodes with too few shared shingles for any link are set aside (an exact count: of the
   first shingles in hash order, then of all shingles).
2. Among the rest, two linked nodes share one of their first n - ceil(t n) + 1 shingles in any one order of all shingles.
   The order is by frequency, the rarest first: a common phrase would bring together nodes that have nothing else in
   common, the more the larger the input. The most typical holder of a shingle is the pivot of all its holders: the
   pivots' regions cover every link.
3. Inside a region distances to its pivot are exact. Nodes within the threshold link to it; the others become further
   pivots in turn, and only pairs inside the triangle-inequality windows of all pivots are compared.
4. Regions beyond a size bound are split first: several pivots make Voronoi cells, and a node is replicated to
   each cell whose pivot is at most twice the threshold further than its own. Cells join recursively; a cell that
   will not shrink, and a region whose members fall into more than two cells each, is joined in blocks.

Links are spanning links (never all pairs of a group); components come from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import release, row_key, staged, table
from ._words import cut_by, grams, mixed, pieces, ragged, tokenize
from .components import components

#: Characters of text for each bucket of the shared-shingle count.
BUCKET_CHARS = 16 << 20
#: Shingles and members of a region that one task joins in memory (its work may grow with the square of the members: some
#: seconds at the bound), and members of two blocks of a cell that pivots cannot split.
REGION_SHINGLES, REGION_MEMBERS, BLOCK_MEMBERS = 4 << 20, 8192, 8192
PIVOTS = 8
LEVELS = 4
#: Shingles of a slice of the sets, and of a bucket of shingles, when frequencies are counted.
SLICE_SHINGLES = 1 << 20

KINDS = "kind int, id long, ref long, n long, dig binary, d64 long, bucket long, a binary, b binary, c binary"
COUNTS = "kind int, id long, ref long, n long, dig binary, d64 long, a binary, b binary"


def required(n, num: int, den: int):
    """Shingles that a set of n must share with any set it links to: ceil(t n)."""
    return -(-(n * num) // den)


def shingle_sets(w, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, a wordless one none."""
    g, out = grams(w.hashes, width), []
    for a, b in zip(w.offsets[:-1], w.offsets[1:]):
        if b - a >= width:
            out.append(np.unique(g[a : b - width + 1]))
        elif b > a:
            out.append(mixed(grams(w.hashes[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _d64(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in KINDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _postings(lists: list[np.ndarray], owners: list[int], buckets: int) -> list[tuple]:
    """Rows that find shared shingles: one kept by two owners here is known as shared and sent once without them, so
    however common it is a piece sends it once; the others go as (32-bit rest of the hash, owner) by bucket. Two of an
    owner that agree in bucket and rest count as shared: the count is never too low."""
    if not lists:
        return []
    h, own = np.concatenate(lists), np.repeat(np.array(owners, np.int64), [len(x) for x in lists])
    order = np.argsort(h)
    h, own = h[order], own[order]
    same = h[1:] == h[:-1]
    shared = np.r_[same, False] | np.r_[False, same]
    rows = []
    if shared.any():
        d, n = np.unique(own[shared], return_counts=True)
        rows.append((2, *[None] * 5, int(h[0] % np.uint64(buckets)), d.tobytes(), n.astype(np.int64).tobytes(), None))
    flags, lone, own = np.unique(h[shared]), h[~shared], own[~shared]
    at = ((lone >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    key = mixed(own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at.astype(np.uint64) << np.uint64(32) | lone & np.uint64(0xFFFFFFFF)))
    twice, run = np.empty(0, np.int64), np.sort(key)
    if (run[1:] == run[:-1]).any():
        alike = np.argsort(key, kind="stable")
        twice = own[alike[1:][key[alike[1:]] == key[alike[:-1]]]]
    if len(twice):
        d, n = np.unique(twice, return_counts=True)
        rows.append((2, *[None] * 5, int(d[0]) % buckets, d.tobytes(), n.astype(np.int64).tobytes(), None))
    flag_at = ((flags >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    known = {b: flags[i].astype(np.uint32).tobytes() for b, i in cut_by(np.argsort(flag_at, kind="stable"), flag_at)}
    for b, i in cut_by(np.argsort(at, kind="stable"), at):
        rows.append((1, *[None] * 5, b, lone[i].astype(np.uint32).tobytes(), own[i].tobytes(), known.pop(b, None)))
    return rows + [(1, *[None] * 5, b, b"", b"", f) for b, f in known.items()]


def _count_shared(group: pa.Table, parts: int) -> pa.Table:
    """Of one bucket: each owner's number of shared shingles, packed by part; rows about documents pass through."""
    kind = group.column("kind").to_numpy()
    docs = group.filter(pa.array(kind == 0)).select([x.split()[0] for x in COUNTS.split(", ")])

    def joined(col: str, k: int, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(x for x in group.filter(pa.array(kind == k)).column(col).to_pylist() if x), dtype)

    h, own, flags = joined("a", 1, np.uint32), joined("b", 1, np.int64), np.unique(joined("c", 1, np.uint32))
    order = np.lexsort((own, h))
    h, own = h[order], own[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
        h, own = h[new], own[new]
    same = h[1:] == h[:-1]
    shared = (np.r_[same, False] | np.r_[False, same] if len(h) else np.zeros(0, bool)) | np.isin(h, flags)
    d = np.r_[own[shared], joined("a", 2, np.int64)]
    d, at = np.unique(d, return_inverse=True)
    n = np.bincount(at, weights=np.r_[np.ones(int(shared.sum())), joined("b", 2, np.int64)], minlength=len(d)).astype(np.int64)
    part, found = d % parts, docs.schema.empty_table().to_pylist()
    for q, i in cut_by(np.argsort(part, kind="stable"), part):
        found.append({"kind": 2, "n": q, "a": d[i].tobytes(), "b": n[i].tobytes()})
    return pa.concat_tables([docs, pa.Table.from_pylist(found, docs.schema)])


def _summed(group: pa.Table) -> pa.Table:
    """Owners of one part with their numbers of shared shingles in all buckets."""
    d, at = np.unique(np.frombuffer(b"".join(group.column("a").to_pylist()), np.int64), return_inverse=True)
    n = np.bincount(at, weights=np.frombuffer(b"".join(group.column("b").to_pylist()), np.int64), minlength=len(d))
    return pa.table({"d64": pa.array(d, pa.int64()), "hits": pa.array(n.astype(np.int64), pa.int64())})


def _listed(width: int, num: int, den: int, buckets: int):
    """Documents to (kind 0) sizes and digests and (kinds 1, 2) postings of their first shingles in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            sets = shingle_sets(tokenize(batch.column(1), fold=True), width)
            rows, lists, owners, seen = [], [], [], set()
            for key, ref, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets):
                dig = _digest(s) if len(s) else None
                rows.append((0, key, ref, len(s), dig, dig and _d64(dig), len(rows) % buckets, None, None, None))
                if dig and dig not in seen:
                    seen.add(dig)
                    lists.append(s[: len(s) - required(len(s), num, den) + 1 + len(s) // 20])
                    owners.append(_d64(dig))
            yield _rows(rows + _postings(lists, owners, buckets))

    return run


def _chosen_sets(width: int):
    """The sets of the documents that stay; (key, expected digest, text) in, one row for each digest out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in pieces(batches, "_text"):
            digs, out = batch.column(0).to_pylist(), []
            for dig, s in zip(digs, shingle_sets(tokenize(batch.column(1), fold=True), width)):
                if len(s) and dig not in seen and _digest(s) == dig:
                    seen.add(dig)
                    out.append((dig, s))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in out], pa.binary()), pa.array([_d64(d) for d, _ in out], pa.int64()), pa.array([len(s) for _, s in out], pa.int64()), pa.array([s.tobytes() for _, s in out], pa.binary())],
                names=["dig", "d64", "n", "set"],
            )

    return run


def _all_postings(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "set"):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            yield _rows(_postings(sets, batch.column(0).to_pylist(), buckets))

    return run


def _slots(h: np.ndarray, slices: int) -> np.ndarray:
    """Bucket and 32-bit rest of shingles, as one number."""
    return (h >> np.uint64(32)) % np.uint64(slices) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _counted_postings(slices: int):
    """(slice, set) to the shingles of each bucket, by slice: how many of each slice, and their rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "set"):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            slots = _slots(np.concatenate(sets or [np.empty(0, np.uint64)]), slices)
            part = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets]).astype(np.int64)
            at = (slots >> np.uint64(32)).astype(np.int64)
            rows = [(b, np.bincount(part[i], minlength=slices).astype(np.uint32).tobytes(), slots[i].astype(np.uint32).tobytes()) for b, i in cut_by(np.lexsort((part, at)), at)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "parts", "rests"])

    return run


def _common(group: pa.Table) -> pa.Table:
    """Of one bucket: for each slice its shingles that four sets or more hold, with the whole logarithm of their number."""
    parts = np.frombuffer(b"".join(group.column("parts").to_pylist()), np.uint32).reshape(group.num_rows, -1)
    rests = np.frombuffer(b"".join(group.column("rests").to_pylist()), np.uint32)
    part = np.repeat(np.tile(np.arange(parts.shape[1]), group.num_rows), parts.ravel())
    rest, at, n = np.unique(rests, return_inverse=True, return_counts=True)
    level = np.log2(n).astype(np.uint8)
    some = level[at] >= 2
    pairs = np.unique(part[some] << 32 | at[some])
    part, at, bucket, rows = pairs >> 32, pairs & 0xFFFFFFFF, group.column("bucket")[0].as_py(), []
    for q, i in cut_by(np.arange(len(pairs)), part):
        rows.append({"part": q, "bucket": bucket, "rests": rest[at[i]].tobytes(), "levels": level[at[i]].tobytes()})
    return pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("rests", pa.binary()), ("levels", pa.binary())]))


def rarest_first(sets: list[np.ndarray], slots: np.ndarray, levels: np.ndarray, slices: int, num: int, den: int) -> list[np.ndarray]:
    """The first n - ceil(t n) + 1 shingles of each set by (level, hash); slots not listed have level 0."""
    order = np.argsort(slots)
    slots, levels, out = np.r_[slots[order], np.uint64(2**64 - 1)], np.r_[levels[order], np.uint8(0)], []
    h = _slots(np.concatenate(sets or [np.empty(0, np.uint64)]), slices)
    at = np.searchsorted(slots, h)
    level, a = np.where(slots[at] == h, levels[at], 0), 0
    for s in sets:
        out.append(s[np.argsort(level[a : a + len(s)], kind="stable")[: len(s) - required(len(s), num, den) + 1]])
        a += len(s)
    return out


def _prefixes(slices: int, num: int, den: int):
    def run(group: pa.Table, common: pa.Table) -> pa.Table:
        joined = lambda col, dtype: np.frombuffer(b"".join(common.column(col).to_pylist()), dtype)
        rests, levels = joined("rests", np.uint32), joined("levels", np.uint8)
        bucket = np.repeat(common.column("bucket").to_numpy(), [len(x) // 4 for x in common.column("rests").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        first = rarest_first(sets, bucket.astype(np.uint64) << np.uint64(32) | rests.astype(np.uint64), levels, slices, num, den)
        at = pa.array(np.repeat(np.arange(len(first)), [len(x) for x in first]).astype(np.int64))
        return pa.table({"s": pa.array(np.concatenate(first or [np.empty(0, np.uint64)]).view(np.int64)), "dig": group.column("dig").take(at), "score": group.column("score").take(at)})

    return run


def _first_shingles(kept: DataFrame, num: int, den: int) -> DataFrame:
    """(s, dig, score) of the first shingles of every set, the rarest first."""
    slices = max(8, int(kept.agg(F.sum("n")).first()[0] or 0) // SLICE_SHINGLES)
    sliced = kept.withColumn("part", F.pmod(F.xxhash64("dig"), F.lit(slices)).cast("long"))
    common = sliced.select("part", "set").mapInArrow(_counted_postings(slices), "bucket long, parts binary, rests binary").groupBy("bucket").applyInArrow(_common, "part long, bucket long, rests binary, levels binary")
    return sliced.select("part", "dig", "score", "set").groupBy("part").cogroup(common.groupBy("part")).applyInArrow(_prefixes(slices, num, den), "s long, dig binary, score double")


class Region:
    """Sets of one region over a dense vocabulary; exact overlaps with a chosen one."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.offs = np.r_[0, np.cumsum(self.n)]
        vocab, self.items = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(vocab), bool)

    def overlap(self, p: int, others: np.ndarray | None = None) -> np.ndarray:
        own = self.items[self.offs[p] : self.offs[p + 1]]
        self.mark[own] = True
        if others is None:
            hit = np.add.reduceat(self.mark[self.items].astype(np.int64), self.offs[:-1])
        else:
            n = self.n[others]
            hit = np.add.reduceat(self.mark[self.items[ragged(self.offs[:-1][others], n)]].astype(np.int64), np.r_[0, np.cumsum(n)[:-1]])
        self.mark[own] = False
        return hit


def region_links(sets: list[np.ndarray], num: int, den: int, outer: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the linked pairs of one region, sets given most typical first. ``outer``: only pairs with
    one of these are wanted."""
    region, g = Region(sets), len(sets)
    root, links, far = np.arange(g), [], []
    resolved = np.zeros(g, bool) if outer is None else ~outer

    def join(p: int, q: int) -> None:
        if root[p] != root[q]:
            links.append((p, q))
            root[root == root[q]] = root[p]

    while not resolved.all():  # each pivot takes all within the threshold; at worst every set is one
        p = int(np.argmin(resolved))
        hit = region.overlap(p)
        union = region.n + region.n[p] - hit
        near = den * hit >= num * union
        for q in np.flatnonzero(near):
            join(p, int(q))
        resolved[p], resolved[near] = True, True
        far.append((p, 1 - hit / union))
    pivots, windows, t = {p for p, _ in far}, np.array([d for _, d in far][:16]), 1 - num / den + 1e-9
    for x in range(g) if (root != root[0]).any() else []:
        if x in pivots or (outer is not None and not outer[x]):
            continue
        size_ok = (den * region.n >= num * region.n[x]) & (den * region.n[x] >= num * region.n)
        near = np.flatnonzero((root != root[x]) & size_ok & (np.abs(windows - windows[:, x : x + 1]) <= t).all(0))
        if len(near):
            hit = region.overlap(x, near)
            for q in near[den * hit >= num * (region.n[near] + region.n[x] - hit)]:
                join(x, int(q))
    return links


def _region_join(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("score", "descending"), ("dig", "ascending")])
        digs = group.column("dig").to_pylist()
        keep = [i for i, d in enumerate(digs) if i == 0 or d != digs[i - 1]]
        sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        outer = group.column("outer").to_numpy(zero_copy_only=False).astype(bool)[keep]
        links = region_links([sets[i] for i in keep], num, den, None if outer.all() else outer) if len(keep) > 1 else []
        return pa.table({"u": pa.array([digs[keep[a]] for a, _ in links], pa.binary()), "v": pa.array([digs[keep[b]] for _, b in links], pa.binary())})

    return run


def _distances(num: int, den: int):
    """Distances of members to their region's pivots: linked pivots, and the cells (with distance) to join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "set"):
            rows: list[tuple] = []
            for r in batch.to_pylist():
                s, ds = np.frombuffer(r["set"], np.uint64), []
                for p in r["pivots"]:
                    q = np.frombuffer(p["set"], np.uint64)
                    hit = len(np.intersect1d(s, q, assume_unique=True))
                    ds.append((1 - hit / (len(s) + len(q) - hit), den * hit >= num * (len(s) + len(q) - hit), p["dig"]))
                home = min(d for d, _, _ in ds)
                rows += [(r["region"], r["dig"], p, d, near) for d, near, p in ds if d <= home + 2 * (1 - num / den) + 1e-9 or near]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_())], names=["region", "dig", "pivot", "d", "near"])

    return run


LINKS = "u binary, v binary"


def _join_regions(members: DataFrame, sets: DataFrame, num: int, den: int, bound: int, most: int) -> DataFrame:
    """Links of all regions. members: (region, dig)."""
    over = (F.col("weight") > bound) | (F.col("g") > most)
    weighed = lambda m: m.join(sets.select("dig", "n"), "dig").groupBy("region").agg(F.sum("n").alias("weight"), F.count("*").alias("g")).filter("g > 1")
    join = lambda m: m.join(sets, "dig").select("region", "dig", "score", "set", "outer").groupBy("region").applyInArrow(_region_join(num, den), LINKS)
    sized = staged(weighed(members), "region-weights")
    links = join(members.join(sized.filter(~over), "region", "left_semi").withColumn("outer", F.lit(True)))
    large = members.join(sized.filter(over), "region").select("region", "dig", "weight", F.col("g").alias("was_g"))
    for level in range(LEVELS + 1):
        if sized.filter(over).isEmpty():
            return links
        large = staged(large.join(sets.select("dig", "n", "score"), "dig"), "large-regions")
        rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("score"), "dig"))
        top = large.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).join(sets.select("dig", "set"), "dig")
        pivots = top.groupBy("region").agg(F.collect_list(F.struct("dig", "set")).alias("pivots"))  # PIVOTS sets at most
        near = large.join(sets.select("dig", "set"), "dig").join(pivots, "region").select("region", "dig", "set", "pivots")
        near = staged(near.mapInArrow(_distances(num, den), "region string, dig binary, pivot binary, d double, near boolean"), "pivot-distances")
        links = links.unionByName(near.filter("near").select(F.col("pivot").alias("u"), F.col("dig").alias("v")))
        # where pivots separate little, cells would repeat the region several times over
        counts = near.groupBy("region").agg(F.count("*").alias("in_cells")).join(large.select("region", "was_g").distinct(), "region")
        pivot = near.filter("near").groupBy("region", "pivot").agg(F.count("*").alias("c")).groupBy("region").agg(F.max(F.struct("c", "pivot"))["pivot"].alias("pivot"))
        whole = staged(counts.filter("in_cells > 2 * was_g").join(pivot, "region").select("region", "pivot"), "whole-regions")
        linked = near.filter("near").join(whole, ["region", "pivot"]).select("region", "dig", F.lit(True).alias("near"))
        flagged = large.join(whole, "region", "left_semi").join(linked, ["region", "dig"], "left")
        links = links.unionByName(_in_blocks(flagged.select("region", "dig", F.coalesce("near", F.lit(False)).alias("near"), "weight", F.col("was_g").alias("g")), sets, num, den, bound))
        cells = near.join(whole, "region", "left_anti").select(F.sha2(F.concat(F.encode("region", "UTF-8"), F.lit(b"/"), "pivot"), 256).alias("region"), "dig", "near", F.col("region").alias("parent"))
        # a cell whose members all link to its pivot is one component already
        open_ = cells.groupBy("region", "parent").agg(F.bool_and("near").alias("done")).filter("not done")
        members = staged(cells.join(open_, ["region", "parent"], "left_semi"), "cells")
        sized = staged(weighed(members.select("region", "dig")), "region-weights")
        fit = members.join(sized.filter(~over), "region", "left_semi")
        links = links.unionByName(join(fit.select("region", "dig").withColumn("outer", F.lit(True))))
        parents = large.select(F.col("region").alias("parent"), F.col("weight").alias("was"), "was_g").distinct()
        rest = members.join(sized.filter(over), "region").join(parents, "parent")
        stays = ((F.col("weight") > 0.8 * F.col("was")) & (F.col("g") > 0.8 * F.col("was_g"))) | F.lit(level + 1 >= LEVELS)
        links = links.unionByName(_in_blocks(rest.filter(stays), sets, num, den, bound))
        large = rest.filter(~stays).select("region", "dig", "weight", F.col("g").alias("was_g"))
        sized = staged(large.select("region", "weight", F.col("was_g").alias("g")).distinct(), "region-weights")
    return links


def _in_blocks(stuck: DataFrame, sets: DataFrame, num: int, den: int, bound: int) -> DataFrame:
    """Members that don't link to their cell's pivot (outer) meet all members, block by block; where few are outer, all
    members travel only as often as those need blocks."""
    blocks = lambda weight, g: F.greatest(F.lit(1), F.ceil(F.col(weight) * 2 / bound), F.ceil(F.col(g) * 2 / BLOCK_MEMBERS)).cast("int")
    few = stuck.filter("not near").join(sets.select("dig", "n"), "dig").groupBy("region").agg(F.sum("n").alias("outer_weight"), F.count("*").alias("outer_g"))
    m = stuck.join(few, "region").select("region", "dig", (~F.col("near")).alias("outer"), blocks("outer_weight", "outer_g").alias("rows"), blocks("weight", "g").alias("cols"))
    m = m.withColumn("row", F.pmod(F.xxhash64("dig"), F.col("rows"))).withColumn("col", F.pmod(F.xxhash64("dig"), F.col("cols")))
    one = m.filter("outer").select("region", "dig", "outer", F.col("row").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    two = m.select("region", "dig", "outer", "row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("col").alias("j"))
    pairs = one.unionByName(two.withColumn("outer", F.col("outer") & (F.col("row") == F.col("i"))).select(one.columns)).distinct()
    name = F.concat_ws("/", "region", "i", "j")
    return pairs.join(sets, "dig").select(name.alias("region"), "dig", "score", "set", "outer").groupBy("region").applyInArrow(_region_join(num, den), LINKS)


def similar_sets(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id", bound: int = REGION_SHINGLES, most: int = REGION_MEMBERS) -> DataFrame:
    """One row for each row of ``docs``: (key, n_shingles, component_id).

    Two documents link when den * |A & B| >= num * |A | B|, over sets of ``width``-word shingles of the lower-cased
    (A-Z) text. component_id is the least key of the component; null keys count as least but are not reported as
    an id unless the component has no other. Null and wordless texts have no shingles and link with nothing;
    repeated rows have equal sets and so one component. Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(row_key(key).alias("_key"), F.col(text).alias("_text")).withColumn("_ref", F.xxhash64("_key", "_text"))
    chars = int(base.agg(F.sum(F.length("_text"))).first()[0] or 0)
    buckets = max(8, chars // BUCKET_CHARS)
    count = lambda group: _count_shared(group, buckets)
    counted = base.mapInArrow(_listed(width, num, den, buckets), KINDS).groupBy("bucket").applyInArrow(count, COUNTS)
    counted = staged(counted, "shingle-counts")
    release(spark)
    sizes = counted.filter("kind = 0")
    nodes = sizes.filter("n > 0").groupBy("dig", "d64", "n").agg(F.min("ref").alias("_ref"), F.min(_id("id")).alias("_least"))
    shared = lambda c: c.filter("kind = 2").select(F.col("n").alias("part"), "a", "b").groupBy("part").applyInArrow(_summed, "d64 long, hits long")
    need = F.ceil(F.col("n") * num / den).cast("long")
    some = nodes.join(shared(counted), "d64").filter(F.col("hits") >= 1 + F.floor(need / 20))
    holders = base
    if not sizes.groupBy("ref").count().filter("count > 1").isEmpty():  # rows that repeat id and text are read once
        holders = base.groupBy("_ref").agg(F.any_value("_text").alias("_text"))
    keyed = lambda df: df.hint("shuffle_hash")  # noqa: E731  short rows with unique keys are hashed, so texts and sets need no sort
    sets = staged(holders.join(keyed(some.select("_ref", "dig")), "_ref").select("dig", "_text").mapInArrow(_chosen_sets(width), "dig binary, d64 long, n long, set binary"), "shingle-sets")
    release(spark)
    again = sets.select("d64", "set").mapInArrow(_all_postings(buckets), KINDS).groupBy("bucket").applyInArrow(count, COUNTS)
    kept = staged(sets.join(keyed(shared(again)), "d64").filter(F.col("hits") >= need).select("dig", "n", (F.col("hits") / F.col("n")).alias("score"), "set"), "near-sets")
    release(spark)
    posts = staged(_first_shingles(kept, num, den), "prefixes")
    release(spark)
    pivots = posts.groupBy("s").agg(F.max(F.struct("score", "dig"))["dig"].alias("pivot"), F.count("*").alias("holders")).filter("holders > 1")
    members = staged(posts.join(pivots, "s").select(F.hex("pivot").alias("region"), "dig").distinct(), "regions")
    release(spark)
    links = staged(_join_regions(members, kept, num, den, bound, most), "near-links")
    release(spark)
    rooted = nodes.select("dig", F.col("dig").alias("root"), "_least")
    if not links.isEmpty():
        roots = components(links, "u", "v").select(F.col("node").alias("dig"), F.col("root").alias("_root"))
        rooted = rooted.join(roots, "dig", "left").select("dig", F.coalesce("_root", "root").alias("root"), "_least")
    first = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = rooted.select("dig", "root").join(first, "root").select("dig", "component_id")
    worded = sizes.filter("n > 0").join(classes, "dig").select("id", "n", "component_id")
    wordless = sizes.filter("n = 0").select("id", "n", _id("id").alias("component_id"))
    return worded.unionByName(wordless).select(_id("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _id(col: str):
    return F.when(F.col(col) != -(2**63), F.col(col))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component stays, that of the least key (a null key comes last; of equal keys the least hash);
    rows without words stay too.

    Rows are told apart by a 64-bit hash of key and text, so rows that share a key but not their text are judged each by
    itself, and of rows that repeat both one stays."""
    row = F.xxhash64(F.col(key).cast("long"), text).alias("_row")
    found = similar_sets(docs.select(row, F.col(text).alias("_text")), key="_row", text="_text", **options).filter("n_shingles > 0")
    found = staged(found.groupBy("_row").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "near-rows")
    release(docs.sparkSession)
    keys = docs.select(row, row_key(key).alias("id"), F.col(key).isNull().alias("last")).distinct()
    first = found.join(keys, "_row").groupBy("component_id").agg(F.min(F.struct("last", "id", "_row"))["_row"].alias("_row"))
    first = staged(first.join(found.select("_row", "n"), "_row").select("_row", "n"), "near-firsts")
    gone, again = found.join(first, "_row", "left_anti").select("_row"), first.filter("n > 1").select("_row")
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), row).join(gone, "_row", "left_anti")
    if not again.isEmpty():
        one = kept.join(again, "_row", "left_semi").groupBy("_row").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
        kept = kept.join(again, "_row", "left_anti").unionByName(one)
    return kept.select("_doc.*")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[p : p + 3], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS hit FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * hit >= 85 * (x.n + y.n - hit)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r, r AS q FROM d UNION SELECT reach.r, edges.b FROM reach JOIN edges ON reach.q = edges.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.r, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.q GROUP BY reach.r) c USING (r)
"""
