"""Prefix trie of conversations as double arrays, one for each range of paths.

1. Turns become 128-bit keys with their length; a conversation is the ordered array of its turns' keys (its path).
   Conversations of the same path are one row: ids go into blocks by range of ``ID_BLOCK`` ids, and blocks are hashed
   one after the other, so a path that many share is neither collected nor hashed in one go.
2. Distinct paths are range-partitioned by path, so a shard is a run of neighbouring paths. Each packs BASE and CHECK
   over dense turn ids and is walked for its nodes and their sums. Only nodes of a shard's first and last path can also
   be in another shard.
3. Those upper nodes are merged over all shards, and their own share is added to their ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sql import CRC_TABLE, crc
from ._stage import staged, table
from ._words import mixed

#: Ids of a block; turns of a shard (a longer conversation is a shard of its own).
ID_BLOCK, SHARD_TURNS = 4096, 500_000
#: Characters of a text by which turns of equal number and role are ordered first.
HEAD = 48
#: Merged upper nodes are broadcast up to so many.
FEW_NODES = 200_000

PATH = "array<struct<a:bigint,b:bigint,n:int>>"
NODES = "shared boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, h binary, ph binary, above array<binary>, ends_sha256 string"


class DoubleArray:
    """A trie of sorted distinct sequences of dense ids: the child of state s by id c is t = base[s] + c if check[t] = s.

    ``first`` gives, for each id, whether this position (depth by depth, then path by path) is its first; ids are
    numbered in that order, so the children of most states have neighbouring ids and fill neighbouring slots."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        self.ids, self.begin, self.length = ids, offsets[:-1], np.diff(offsets)
        size = 2 * len(ids) + int(ids.max(initial=0)) + 64
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.check[0] = 0  # the root, its own parent
        self.end = 1  # no slot from here on is used
        self.low = 1  # every slot before it is used
        seen = 0
        at = np.zeros(len(self.length), np.int64)
        for depth in range(int(self.length.max(initial=0))):
            live = np.flatnonzero(self.length > depth)
            state, c = at[live], ids[self.begin[live] + depth]
            new = np.r_[True, (state[1:] != state[:-1]) | (c[1:] != c[:-1])]
            seen = self._insert(state[new], c[new], seen)
            at[live] = self.base[state] + c
        self.base, self.check = self.base[: self.end], self.check[: self.end]

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size - len(self.check), len(self.check) // 2)
            self.base, self.check = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.check, np.full(more, -1, np.int64)]

    def _put(self, state: np.ndarray, c: np.ndarray) -> None:
        slot = self.base[state] + c
        self.check[slot] = state
        self.end = max(self.end, int(slot.max()) + 1)

    def _insert(self, state: np.ndarray, c: np.ndarray, seen: int) -> int:
        """The children of one depth: (state, c) pairs, by state. Ids from ``seen`` on are new at this depth."""
        head = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
        count = np.diff(np.r_[head, len(state)])
        run = np.repeat(np.arange(len(head)), count)
        fresh, new = np.zeros(len(c), bool), np.flatnonzero(c >= seen)
        fresh[new[np.unique(c[new], return_index=True)[1]]] = True
        easy = np.bincount(run, ~fresh, minlength=len(head)) == 0  # all children have new ids of their own: one shift fits all
        mine = easy[run]
        if mine.any():
            low = int(c[mine].min())
            self._room(self.end + int(c[mine].max()) - low + 1)
            self.base[state[mine]] = self.end - low
            self._put(state[mine], c[mine])
        several = np.flatnonzero(~easy & (count > 1))
        for i in several[np.argsort(-count[several], kind="stable")]:
            part = slice(head[i], head[i] + count[i])
            self.base[state[head[i]]] = self._fit(c[part])
            self._put(state[part], c[part])
        one = head[~easy & (count == 1)]
        if len(one):  # any free slot will do
            self._room(self.end + len(one))
            free = np.flatnonzero(self.check[self.low : self.end + len(one)] < 0)[: len(one)] + self.low
            self.base[state[one]] = free - c[one]
            self._put(state[one], c[one])
            self.low = int(free[-1]) + 1
        return max(seen, int(c.max()) + 1)

    def _fit(self, c: np.ndarray) -> int:
        """The first base (of some hundred free slots for the least id) that leaves every child a free slot."""
        low, span = int(c.min()), int(c.max() - c.min())
        self._room(self.end + span + 1)
        free = np.flatnonzero(self.check[self.low : self.low + 4096] < 0)[:512] + self.low
        free = free[free < self.end]
        near = free[:, None] + (c - low)[None, :]
        self._room(int(near.max(initial=0)) + 1)
        fits = np.flatnonzero((self.check[near] < 0).all(1)) if len(free) else []
        return int(free[fits[0]] if len(fits) else self.end) - low

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(paths, states) depth by depth, the root first, by following BASE and proving each step with CHECK."""
        live, state = np.arange(len(self.length)), np.zeros(len(self.length), np.int64)
        depth = 0
        while len(live):
            yield live, state
            on = self.length[live] > depth
            live, state = live[on], state[on]
            to = self.base[state] + self.ids[self.begin[live] + depth]
            if not (self.check[to] == state).all():
                raise AssertionError("a path is not in its trie")
            state, depth = to, depth + 1


def dense_ids(a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0 .. k - 1 for the distinct (a, b), by first place, depth by depth and then path by path."""
    length = np.diff(offsets)
    path = np.repeat(np.arange(len(length)), length)
    depth = np.arange(len(a)) - offsets[:-1][path]
    by_depth = np.argsort(depth, kind="stable")
    order = np.lexsort((by_depth.argsort(), b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    rank = np.empty(int(new.sum()), np.int64)
    rank[np.argsort(by_depth.argsort()[order[new]])] = np.arange(len(rank))
    out = np.empty(len(a), np.int64)
    out[order] = rank[group]
    return out


def shard_nodes(a: np.ndarray, b: np.ndarray, n: np.ndarray, offsets: np.ndarray, weight: np.ndarray, least: np.ndarray, sha: list[str]) -> pa.RecordBatch:
    """Nodes of the trie of some neighbouring paths, with what these paths contribute to each.

    Nodes on the first or last path are ``shared``: their counts leave out each other (children, leaves and savings of
    shared nodes), which ``prefix_nodes`` adds once all shards are merged."""
    trie = DoubleArray(dense_ids(a, b, offsets), offsets)
    size, paths = len(trie.check), len(weight)
    convs, conv, chars, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    h1, h2, shared, end = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, bool), np.full(size, -1, np.int64)
    parent, levels = np.full(size, -1, np.int64), []
    for d, (live, state) in enumerate(trie.walk()):
        head = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
        node = state[head]
        convs[node], conv[node] = np.add.reduceat(weight[live], head), np.minimum.reduceat(least[live], head)
        depth[node] = d
        if d:
            at = offsets[live[head]] + d - 1
            chars[node], up = n[at], trie.check[node]
            parent[node] = up
            h1[node] = mixed(h1[up] * np.uint64(3) + a[at].view(np.uint64) + np.uint64(1))
            h2[node] = mixed(h2[up] * np.uint64(5) + b[at].view(np.uint64) + np.uint64(2))
        shared[state[live == 0]] = shared[state[live == paths - 1]] = True
        stops = offsets[live + 1] - offsets[live] == d
        end[state[stops]] = live[stops]
        levels.append(node)
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for node in reversed(levels):
        own = node[~shared[node]]
        leaves[own] += children[own] == 0
        saved[own] += (convs[own] - 1) * chars[own]
        up = node[parent[node] >= 0]
        np.add.at(children, parent[own[parent[own] >= 0]], 1)
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    node = np.concatenate(levels)
    key, up = np.stack([h1, h2], 1), parent[node]
    names = {int(i): key[i].tobytes() for i in np.flatnonzero(shared)}
    chains: dict[int, list[bytes]] = {0: []}
    for i in node[shared[node]][1:].tolist():  # a parent comes before its children
        chains[i] = [names[int(parent[i])], *chains[int(parent[i])]]
    of = lambda ids, values: pa.array([values.get(i) for i in ids.tolist()], pa.list_(pa.binary()) if values is chains else pa.binary())
    has_up = up >= 0
    empty = hashlib.sha256(b"").hexdigest()
    ends = [sha[e] if e >= 0 else empty for e in end[node]]
    ints = [depth[node], conv[node], None, convs[node], children[node], leaves[node], saved[node], chars[node]]
    ints[2] = pa.array(np.where(has_up, conv[up], 0), pa.int64(), mask=~has_up)
    return pa.RecordBatch.from_arrays(
        [pa.array(shared[node]), *[x if isinstance(x, pa.Array) else pa.array(x) for x in ints], of(node, names), of(up, names), of(node, chains), pa.array(ends, pa.string())],
        names=[x.split()[0] for x in NODES.split(", ")],
    )


def _tries(limit: int):
    """Paths of one range in order, cut into shards of about ``limit`` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        turns = 0
        for batch in batches:
            length = np.diff(batch.column(0).offsets.to_numpy())
            total, i = np.cumsum(length), 0
            while i < len(length):
                j = int(np.searchsorted(total, (total[i - 1] if i else 0) + max(1, limit - turns), "left")) + 1
                held.append(batch.slice(i, j - i))
                turns += int(length[i:j].sum())
                i = min(j, len(length))
                if turns >= limit:
                    yield solve(held)
                    held, turns = [], 0
        if held:
            yield solve(held)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        path = t.column(0).combine_chunks()
        path = path.chunk(0) if isinstance(path, pa.ChunkedArray) else path
        flat, offsets = path.flatten(), np.r_[0, np.cumsum(path.value_lengths().to_numpy())]
        a, b, n = (flat.field(i).to_numpy() for i in range(3))
        return shard_nodes(a, b, n.astype(np.int64), offsets, t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(3).to_pylist())

    return run


ENDS = f"path {PATH}, n long, conv_id long, sha string"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (p1, p2, block, n, conv_id, ids, path) by path and range of ids, in order, to one row a path: (path, members,
    least id, hash of all ids)."""
    key, path, row, sha = None, None, None, None
    for batch in batches:
        if not len(batch):
            continue
        p1, p2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.r_[key != (p1[0], p2[0]), (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]
        key, begun, done = (p1[-1], p2[-1]), np.flatnonzero(new), []
        for fresh, n, conv, ids in zip(new.tolist(), *(batch.column(i).to_pylist() for i in (3, 4, 5))):
            if fresh:
                if row:
                    done.append((*row, sha.hexdigest()))
                row, sha = [n, conv], hashlib.sha256(ids.encode())
            else:
                row[0] += n
                sha.update(b"," + ids.encode())
        if len(begun):
            paths = batch.column(6).take(pa.array(begun))
            closed = pa.concat_arrays([*([path] if path is not None else []), paths[:-1]])
            path = paths[-1:]
            yield _ends_batch(closed, done)
    if row:
        yield _ends_batch(path, [(*row, sha.hexdigest())])


def _ends_batch(paths: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, conv, sha = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([paths, pa.array(n, pa.int64()), pa.array(conv, pa.int64()), pa.array(sha, pa.string())], names=["path", "n", "conv_id", "sha"])


def turn_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path): the keys of each conversation's turns, in the order of turn (null first), then role, then text.

    Whole texts travel only for conversations that have different turns of equal number, role and head of the text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.length("text").alias("n"))

    def ordered(df: DataFrame, head: Column) -> DataFrame:
        turn = F.struct("turn", "role", head.alias("head"), key.alias("key"))  # arrays sort nulls first
        return df.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    first = ordered(rows, F.substring("text", 1, HEAD))
    same = lambda x, y: x["turn"].eqNullSafe(y["turn"]) & (x["role"] == y["role"]) & (x["head"] == y["head"]) & (x["key"] != y["key"])
    alike = F.exists(F.zip_with(F.slice("ts", 1, F.size("ts") - 1), F.slice("ts", 2, F.size("ts")), same), lambda x: x)
    path = F.col("ts.key").alias("path")
    first = staged(first.select("conv_id", path, alike.alias("alike")), "turn-paths")
    tied = first.filter("alike").select("conv_id")
    if tied.isEmpty():
        return first.select("conv_id", "path")
    again = ordered(rows.join(tied, "conv_id", "left_semi"), F.col("text")).select("conv_id", path)
    return first.filter("NOT alike").select("conv_id", "path").unionByName(again)


def rebuilt_paths(paths: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % span; h = crc32(c) % most."""
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    bases = paths.filter(F.col("conv_id") % span == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, most - 1).alias("head"))
    rows = paths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % span).alias("base"), h.cast("int").alias("h"), "path").join(bases, "base", "left")
    own = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.array().cast(PATH)), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(head, own).alias("path"))


def prefix_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of (conv_id, path): conv_id (least member), depth, parent_conv_id (root: null), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Ids are unique; a path may be empty (its end is the root). No conversation gives no node. A conversation's keys (24
    bytes a turn) must fit a task; nothing else is held whole. Equal turns are told by 128 bits of hash.
    """
    p = paths.select("conv_id", "path", F.xxhash64("path").alias("p1"), F.xxhash64(F.lit(1), "path").alias("p2"), F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
    ids = F.sort_array(F.collect_list("conv_id"))
    blocks = p.groupBy("p1", "p2", "block").agg(ids.alias("ids"), F.first("path").alias("path"))
    blocks = blocks.select("p1", "p2", "block", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("conv_id"), F.array_join("ids", ",").alias("ids"), "path")
    ends = staged(blocks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "block").mapInArrow(_ends, ENDS), "paths")
    turns = ends.agg(F.sum(F.size("path"))).first()[0] or 0
    shards = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    nodes = staged(ends.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInArrow(_tries(shard_turns), NODES), "trie-nodes")

    upper = nodes.filter("shared").groupBy("h").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("ph").alias("ph"), F.first("above").alias("above"), F.first("chars").alias("chars"), F.max("ends_sha256").alias("last"), F.min("ends_sha256").alias("first"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    upper = staged(upper, "upper-nodes")
    below = upper.filter("ph IS NOT NULL").groupBy("ph").agg(F.count("*").alias("more")).withColumnRenamed("ph", "h")
    upper = upper.join(below, "h", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = upper.select(F.explode(F.concat(F.array("h"), "above")).alias("h"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    own = own.groupBy("h").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    none = hashlib.sha256(b"").hexdigest()
    merged = upper.join(own, "h").select(
        "h", "ph", "depth", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"),
        F.when(F.col("last") == none, F.col("first")).otherwise(F.col("last")).alias("ends_sha256"),
    )
    merged = staged(merged, "merged-nodes")
    names = merged.select(F.col("h").alias("ph"), F.col("conv_id").alias("up"))
    names = F.broadcast(names) if merged.count() <= FEW_NODES else names
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rest = nodes.filter("NOT shared").select("ph", *columns).unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select("ph", *columns))
    return rest.join(names, "ph", "left").withColumn("parent_conv_id", F.coalesce("up", "parent_conv_id")).select(columns)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_nodes(rebuilt_paths(turn_paths(table(spark, sf_dir, "conversations"))))


OP11_SQL = f"""
WITH {CRC_TABLE},
c AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
hh AS (SELECT conv_id, w, {crc('conv_id')} % 6 AS h FROM c, crc_table),
built AS (SELECT a.conv_id, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w FROM hh a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 100),
m AS (SELECT conv_id, d, w[1:d] AS p, len(w) AS n FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM built)),
g AS (
  SELECT d, p, min(conv_id) AS c, count(*) AS n_convs, (max(n) = d)::INT AS leaf, coalesce((count(*) - 1) * length(any_value(p[d]).t), 0) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY d, p
),
k AS (SELECT m.conv_id, m.d, g.c FROM m JOIN g USING (d, p)),
s AS (SELECT k.c, k.d, sum(leaf) AS n_leaves, sum(own) AS saved, count(*) FILTER (g.d = k.d + 1) AS n_children FROM g JOIN k ON k.conv_id = g.c AND k.d <= g.d GROUP BY 1, 2)
SELECT g.c AS conv_id, g.d AS depth, u.c AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM g JOIN s ON s.c = g.c AND s.d = g.d LEFT JOIN k u ON u.conv_id = g.c AND u.d = g.d - 1
"""
