"""Removal of repeated passages with a compressed FM-index for each shard.

A window is ``width`` consecutive words; every occurrence but the first (least id, then least start) is removed. Hashes
only route: whether a window repeats is decided by an FM-index of the words that meet in one task (``repeated``). They
are streamed through backward search over the wavelet ranks; where the matching statistic reaches ``width`` words in
more than one suffix, the interval's suffixes are located and the earliest stays.

1. Each window belongs to its least 6-word hash (its anchor), so equal windows have equal anchors. A bounded piece of
   documents is a shard of its own: it indexes the windows whose anchor stands in several places, and only first
   occurrences go on. Anchors are counted over the corpus.
2. Stretches of windows whose anchor occurs again go to the anchor's shard, windows of very common anchors singly by
   their own hash, once for each task. The shard indexes its stretches and streams them.
3. Removal spans are cut from each document's whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import release, row_key, staged, table
from ._words import Words, cut_by, grams, pieces, ragged, tokenize, within
from .fm_index import FMIndex

ANCHOR = 6
#: Characters of text for each anchor bucket and for each index shard.
BUCKET_CHARS = 16 << 20
SHARD_CHARS = 8 << 20
#: Documents that share an anchor, in a piece or in all, beyond which its windows are dealt out singly.
HOT_HERE, HOT = 8, 4096
#: Windows of a stretch, at most.
STRETCH = 64
#: Suffix positions of a shard's index: one in so many is kept.
SAMPLE = 16

#: Characters of text for each group that spans are cut from.
CUT_CHARS = 16 << 20
SPAN_COLUMNS = "refs binary, begins binary, ends binary"
COUNTED = f"kind int, part long, {SPAN_COLUMNS}, cells binary, hots binary"
TAGGED = COUNTED + ", bucket long, a binary, b binary, c binary"
SEGMENTS = f"shard long, ref binary, k binary, start binary, count binary, words binary, part long, {SPAN_COLUMNS}"
SPANS = f"part long, {SPAN_COLUMNS}"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, _text, ref, n): in each piece, rows that repeat an id and a text are one, with their number."""
    for batch in pieces(batches, "_text"):
        own = batch.select(["k", "_text", "ref"])
        _, at, n = np.unique(own.column("ref").to_numpy(), return_index=True, return_counts=True)
        order = np.argsort(at)
        own = own.take(pa.array(at[order]))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n[order].astype(np.int64))], names=["k", "_text", "ref", "n"])


def _sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each position on."""
    width = 1
    while 2 * width <= n:
        g, width = np.minimum(g[:-width], g[width:]), 2 * width
    return np.minimum(g[: len(g) - (n - width)], g[n - width :]) if n > width else g


def repeated(words: np.ndarray, at: np.ndarray, seq: np.ndarray, key: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Which windows (words[at : at + width] of sequence seq, at key and start) also start at an earlier (key, start)
    among those given. Windows come by sequence and position. All are indexed and streamed: the index decides."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    head, count = stretches(at, seq)
    size = count + width - 1
    vocab, ids = np.unique(words[ragged(at[head], size)], return_inverse=True)
    index = FMIndex(ids, size, len(vocab), depth=width - 1, sample=SAMPLE)
    found = index.matches(ids, size, width)
    own = head[found.seq] + found.start
    several = found.hi - found.lo > 1
    lo, first, of = np.unique(found.lo[several], return_index=True, return_inverse=True)
    rows = found.hi[several][first] - lo
    place = index.locate(ragged(lo, rows))
    run = np.searchsorted(index.begins, place, "right") - 1
    there = head[run] + place - index.begins[run]  # the windows that share each interval
    order = np.lexsort((start[there], key[there], np.repeat(np.arange(len(lo)), rows)))
    least = there[order][np.cumsum(rows) - rows][of]
    own, shift = own[several], found.shift[several]
    out[own] = (key[own] != key[least]) | (start[own] != start[least] - shift)
    return out


def stretches(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the runs of neighbouring windows that agree in ``same``, cut to ``STRETCH`` windows."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = at[1:] != at[:-1] + 1
    for x in same:
        new |= x[1:] != x[:-1]
    begin = np.flatnonzero(np.r_[True, new])
    split = -(-np.diff(np.r_[begin, len(at)]) // STRETCH)
    begin = np.repeat(begin, split) + ragged(np.zeros(len(split), np.int64), split) * STRETCH
    return begin, np.diff(np.r_[begin, len(at)])


class Piece:
    """Windows of a bounded run of documents, taken by ascending key."""

    def __init__(self, batch: pa.RecordBatch, width: int, buckets: int):
        names = batch.schema.names
        k = batch.column(names.index("k")).to_numpy()
        self.order = np.argsort(k, kind="stable")
        batch = batch.take(pa.array(self.order))
        self.batch, self.width, self.k, self.ref = batch, width, k[self.order], batch.column(names.index("ref")).to_numpy()
        self.words: Words = tokenize(batch.column(names.index("_text")))
        h, offsets = self.words.hashes, self.words.offsets
        self.at, self.doc = within(offsets, width)
        self.start = self.at - offsets[:-1][self.doc]
        self.grams = grams(h, ANCHOR) if len(self.at) else np.empty(0, np.uint64)
        self.low = low = _sliding_min(self.grams, width - ANCHOR + 1)[self.at] if len(self.at) else self.grams
        self.cell = (((low >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (low & np.uint64(0xFFFFFFFF))).astype(np.int64)

    def met(self) -> np.ndarray:
        """The windows whose anchor stands in more than one place of the piece: all that may repeat here."""
        values, count = np.unique(self.grams, return_counts=True)
        return np.flatnonzero(count[np.searchsorted(values, self.low)] > 1)

    def repeated(self, w: np.ndarray) -> np.ndarray:
        """Which of the windows ``w`` start earlier among them."""
        return repeated(self.words.hashes, self.at[w], self.doc[w], self.k[self.doc[w]], self.start[w], self.width)

    def spans(self, windows: np.ndarray, parts: int) -> Iterator[tuple]:
        return span_rows(self.ref, self.doc[windows], self.start[windows], self.width, parts)


def span_rows(refs: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int, parts: int) -> Iterator[tuple]:
    """(part, refs, begins, ends): word spans of runs of neighbouring windows that come sorted by document and start,
    packed by the part of the documents that they are cut from. Spans of separate runs stay separate, though they may
    overlap, so the windows can be told from them."""
    if len(doc):
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])
        ref, begin, end = refs[doc[new]], start[new], start[np.r_[new[1:], len(doc)] - 1] + width
        part = ref % parts
        for p, i in cut_by(np.argsort(part, kind="stable"), part):
            yield p, ref[i].tobytes(), begin[i].astype(np.int32).tobytes(), end[i].astype(np.int32).tobytes()


def packed(words: np.ndarray) -> bytes:
    """Word hashes cut to 48 bits, which travel."""
    return np.ascontiguousarray(words.view(np.uint16).reshape(-1, 4)[:, :3]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), np.uint16)
    out[:, :3] = np.frombuffer(raw, np.uint16).reshape(-1, 3)
    return out.view(np.uint64).ravel()


def _counting(width: int, buckets: int, parts: int):
    """Spans of the repeats found inside a piece; anchors of its other windows, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None,) * 6
        for batch in _collapsed(batches):
            p = Piece(batch, width, buckets)
            met, repeat = p.met(), np.zeros(len(p.at), bool)
            repeat[met] = p.repeated(met)
            rows = [(0, *s, None, None, s[0] % buckets, None, None, None) for s in p.spans(np.flatnonzero(repeat), parts)]
            live = np.flatnonzero(~repeat)
            live = live[np.argsort(p.cell[live], kind="stable")]  # by cell, then by document
            cell, doc = p.cell[live], p.doc[live]
            once = np.r_[True, (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])] if len(live) else np.empty(0, bool)
            cell, doc = cell[once], doc[once]
            cells, counts = np.unique(cell, return_counts=True)
            hot = cells[counts > HOT_HERE]
            is_hot = np.isin(cell, hot)
            for f in flag_rows(p.ref[doc[is_hot]], cell[is_hot], np.ones(int(is_hot.sum()), bool), parts):
                rows.append((2, *f, f[0] % buckets, None, None, None))
            cell, ref = cell[~is_hot], p.ref[doc[~is_hot]]
            known = {b: hot[i].astype(np.uint32).tobytes() for b, i in cut_by(np.arange(len(hot)), hot >> 32)}
            for b, i in cut_by(np.arange(len(cell)), cell >> 32):  # sorted by cell, so by bucket
                rows.append((1, *none, b, cell[i].astype(np.uint32).tobytes(), ref[i].tobytes(), known.pop(b, None)))
            rows += [(1, *none, b, b"", b"", f) for b, f in known.items()]
            yield _batch(TAGGED, rows)

    return run


def flag_rows(ref: np.ndarray, cell: np.ndarray, hot: np.ndarray, parts: int) -> Iterator[tuple]:
    """(part, refs, -, -, cells, hots): documents and their repeated anchors, packed by part."""
    part = ref % parts
    for q, i in cut_by(np.argsort(part, kind="stable"), part):
        yield q, ref[i].tobytes(), None, None, cell[i].tobytes(), hot[i].tobytes()


def _repeated_anchors(group: pa.Table, parts: int) -> pa.Table:
    """Of one bucket: the anchors of each document that occur again, and those of them that are very common."""
    kind = group.column("kind").to_numpy()
    bucket = group.column("bucket")[0].as_py()
    names = [x.split()[0] for x in COUNTED.split(", ")]
    rest = group.filter(pa.array(kind != 1)).select(names)
    posts = group.filter(pa.array(kind == 1))
    joined = lambda col, dtype: np.frombuffer(b"".join(x for x in posts.column(col).to_pylist() if x), dtype)
    low, ref, flags = joined("a", np.uint32), joined("b", np.int64), np.unique(joined("c", np.uint32))
    order = np.lexsort((ref, low))  # a document that pieces repeat counts once
    low, ref = low[order], ref[order]
    once = np.r_[True, (low[1:] != low[:-1]) | (ref[1:] != ref[:-1])] if len(low) else np.empty(0, bool)
    low, ref = low[once], ref[once]
    _, at, counts = np.unique(low, return_inverse=True, return_counts=True)
    n, flagged = counts[at] if len(low) else np.empty(0, int), np.isin(low, flags)
    again, hot = (n > 1) | flagged, flagged | (n > HOT)
    cell = low.astype(np.int64) | (bucket << 32)
    rows = [(3, *f) for f in flag_rows(ref[again], cell[again], hot[again], parts)]
    flags = pa.Table.from_batches([_batch(COUNTED, rows)])
    return pa.concat_tables([rest.cast(flags.schema), flags])


def _sorted_by_ref(table: pa.Table, *columns: tuple[str, type]) -> tuple[np.ndarray, ...]:
    """The packed columns end to end, by ref."""
    ref, *rest = (np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x), t) for c, t in (("refs", np.int64), *columns))
    order = np.argsort(ref, kind="stable")
    return ref[order], *[x[order] for x in rest]


def _sent(width: int, buckets: int, shards: int, parts: int):
    """Segments of the documents of one part for the shards of their repeated anchors."""

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        kind = counted.column("kind").to_numpy()
        ref, cell, very = _sorted_by_ref(counted.filter(pa.array(kind > 1)), ("cells", np.int64), ("hots", bool))
        known, begin, end = _sorted_by_ref(counted.filter(pa.array(kind == 0)), ("begins", np.int32), ("ends", np.int32))
        out: list[pa.RecordBatch] = []
        docs = docs.take(pa.array(np.sort(np.unique(docs.column("ref").to_numpy(), return_index=True)[1])))
        for batch in pieces(docs.to_batches(), "_text"):
            p, rows = Piece(batch, width, buckets), []
            edge = np.searchsorted(p.doc, np.arange(len(batch) + 1))
            first, last = np.searchsorted(ref, p.ref, "left"), np.searchsorted(ref, p.ref, "right")
            a, b = np.searchsorted(known, p.ref, "left"), np.searchsorted(known, p.ref, "right")
            again, hot = np.zeros(len(p.at), bool), np.zeros(len(p.at), bool)
            for d in np.flatnonzero(first < last):
                part, own, common = slice(edge[d], edge[d + 1]), cell[first[d] : last[d]], very[first[d] : last[d]]
                again[part] = np.isin(p.cell[part], own[~common])
                hot[part] = np.isin(p.cell[part], own[common])
                for i in range(a[d], b[d]):  # windows removed already
                    gone = slice(edge[d] + begin[i], edge[d] + end[i] - width + 1)
                    again[gone] = hot[gone] = False
            again &= ~hot
            single = np.flatnonzero(hot)
            twice = p.repeated(single)  # of a very common anchor: the first here goes for all
            gone, single = single[twice], single[~twice]
            w = np.flatnonzero(again)
            head, length = stretches(p.at[w], p.doc[w], p.cell[w])
            first, count = np.r_[w[head], single], np.r_[length, np.ones(len(single), np.int64)]
            own = grams(p.words.hashes, width)[p.at[single]] if len(single) else np.empty(0, np.uint64)
            shard = np.r_[p.cell[w[head]] % shards, (own % np.uint64(shards)).astype(np.int64)]
            for s, i in cut_by(np.argsort(shard, kind="stable"), shard):
                f, n = first[i], count[i]
                words = packed(p.words.hashes[ragged(p.at[f], n + width - 1)])
                rows.append((s, p.ref[p.doc[f]].tobytes(), p.k[p.doc[f]].tobytes(), p.start[f].tobytes(), n.tobytes(), words, None, None, None, None))
            rows += [(x[0] % shards, None, None, None, None, None, *x) for x in p.spans(gone, parts)]
            out.append(_batch(SEGMENTS, rows))
        return pa.Table.from_batches(out or [_batch(SEGMENTS, [])])

    return run


def _matched(width: int, parts: int):
    """Of one shard: removal spans of the windows that its index also holds earlier."""

    def run(group: pa.Table) -> pa.Table:
        done = group.filter(group.column("part").is_valid()).select([x.split()[0] for x in SPANS.split(", ")])
        segs, rows = group.filter(group.column("part").is_null()), []
        if len(segs):
            ref, k, start, count = (np.frombuffer(b"".join(segs.column(c).to_pylist()), np.int64) for c in ("ref", "k", "start", "count"))
            words = unpacked(b"".join(segs.column("words").to_pylist()))
            size = count + width - 1
            order = np.lexsort((start, ref, k))  # segment by segment the text is in order of (key, start)
            words = words[ragged((np.cumsum(size) - size)[order], size[order])]
            ref, k, start, count, size = ref[order], k[order], start[order], count[order], size[order]
            seg = np.repeat(np.arange(len(size)), count)
            base = np.cumsum(size) - size
            at = ragged(base, count)
            begin = start[seg] + at - base[seg]
            gone = np.flatnonzero(repeated(words, at, seg, k[seg], begin, width))
            doc = np.cumsum(np.r_[False, (k[1:] != k[:-1]) | (ref[1:] != ref[:-1])])
            d, s = doc[seg[gone]], begin[gone]
            o = np.lexsort((s, d))
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            rows = list(span_rows(ref[head], d[o], s[o], width, parts))
        own = pa.Table.from_batches([_batch(SPANS, rows)])
        return pa.concat_tables([done.cast(own.schema), own])

    return run


def _cutting(texts: bool):
    """Documents of one part and all their spans: sizes, hashes and (if asked for) texts of the words that stay."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        ref, begin, end = _sorted_by_ref(spans, ("begins", np.int32), ("ends", np.int32))
        own = docs.column("ref").to_numpy()
        first, last = np.searchsorted(ref, own, "left"), np.searchsorted(ref, own, "right")
        total, removed, shas, kept = [], [], [], []
        for d, text in enumerate(docs.column("_text")):
            words = (text.as_py() or "").encode().split()
            n = len(words)
            if first[d] < last[d]:
                keep = np.ones(n, bool)
                for i in range(first[d], last[d]):
                    keep[begin[i] : end[i]] = False
                words = list(compress(words, keep.tolist()))
            rest = b" ".join(words)
            total.append(n)
            removed.append(n - len(words))
            shas.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode() if texts else None)
        columns = [docs.column("k"), docs.column("n"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())]
        return pa.table(columns, names=["k", "n", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = 20, text: str = "text", key: str = "doc_id", texts: bool = True) -> DataFrame:
    """One row for each row of ``docs``: (key, n_words, n_removed, kept_sha256, kept); ``kept`` holds the words left,
    joined by one space (null without ``texts``), and kept_sha256 is its hash.

    Null texts and texts of fewer than ``width`` words lose nothing. Windows at the same key and start (rows that
    repeat an id and a text) are no earlier than each other, and travel as one row of each piece; null keys come before all others. Extra columns are not
    read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(row_key(key).alias("k"), F.col(text).alias("_text")).withColumn("ref", F.xxhash64("k", "_text"))
    chars = int(base.agg(F.sum(F.length("_text"))).first()[0] or 0)
    buckets, shards, parts = (max(8, chars // n) for n in (BUCKET_CHARS, SHARD_CHARS, CUT_CHARS))
    again = lambda group: _repeated_anchors(group, parts)
    counted = staged(base.mapInArrow(_counting(width, buckets, parts), TAGGED).groupBy("bucket").applyInArrow(again, COUNTED), "anchors")
    release(spark)
    by_part = base.mapInArrow(_collapsed, "k long, _text string, ref long, n long").withColumn("part", F.pmod("ref", F.lit(parts)))
    segments = by_part.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(_sent(width, buckets, shards, parts), SEGMENTS)
    found = staged(segments.groupBy("shard").applyInArrow(_matched(width, parts), SPANS), "removal-spans")
    del segments
    release(spark)
    spans = counted.filter("kind = 0").select(*found.columns).unionByName(found)
    out = by_part.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_cutting(texts), "k long, n long, n_words long, n_removed long, kept_sha256 string, kept string")
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))  # no more than the rows of a piece
    return out.select(F.when(F.col("k") != -(2**63), F.col("k")).alias(key), "n_words", "n_removed", "kept_sha256", "kept")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, p, array_to_string(w[p : p + 19], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)
), gone AS (
  SELECT r, p FROM (SELECT *, min({'d': doc_id, 'p': p}) OVER (PARTITION BY s) AS f FROM win) WHERE f < {'d': doc_id, 'p': p}
), covered AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS q FROM gone),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (r, q) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
