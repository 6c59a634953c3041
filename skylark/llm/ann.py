"""Approximate nearest neighbours by cross-polytope hashing.

A rotation hashes a unit vector to the signed axis that is nearest after a pseudo-rotation (rounds of random signs and a
fast Hadamard transform); a table's code joins two rotations, three for more than ``TWO_ROTATIONS`` vectors and one more
for each 2n times as many. Queries probe the codes next in order too. A vector that meets a query in several tables is
a candidate. The more vectors there are, the nearer the nearest lie, so the fewer codes are probed (by the cube root), and
the share of the vectors that is met or compared shrinks. Candidates are ranked by exact distance.

Only ids travel through the tables: codes and probes meet in groups of bounded size, hits are counted for blocks of
queries, and candidate lists go to the block of vectors that holds them. Equal vectors are one node, so copies cost
nothing. A query with too few candidates is compared with all vectors, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import staged, table
from ._words import cut_by, ragged

TABLES = 48
#: Codes probed in a table for up to ``PROBED`` vectors, and the tables in which a candidate must meet a query.
PROBES, PROBED, LEAST = 192, 2000, 3
#: For so few vectors two tables do.
FEW = 1000
#: Axes of each rotation that probes are made of: the nearest.
PROBE_AXES = 64
#: Up to so many vectors a code joins two rotations; PROBES times GROWTH codes are probed for each rotation more.
TWO_ROTATIONS, GROWTH = 1 << 18, 24
#: Codes that one group holds, about; vectors of a block; hits that are counted at once, about; queries of a block.
GROUP_CODES, BLOCK, COUNTED, QUERIES = 1 << 18, 8192, 4 << 20, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of the columns (a power of two long)."""
    h, n = 1, len(x)
    x = x / np.sqrt(n).astype(x.dtype)
    while h < n:
        pairs = x.reshape(n // (2 * h), 2, h, -1)
        x = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], 1).reshape(n, -1)
        h *= 2
    return x


def rotations(vectors: np.ndarray, count: int, seed: int) -> Iterator[np.ndarray]:
    """``count`` pseudo-rotations of the rows' unit vectors, one column for each row."""
    unit = vectors / np.abs(vectors).max(1, initial=1e-300, keepdims=True)  # large and tiny components square safely
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    n = 1 << max(0, vectors.shape[1] - 1).bit_length()
    signs = lambda *key: np.random.default_rng([seed, n, *key]).choice(np.array([-1, 1], np.float32), (n, 1))
    x = np.zeros((n, len(unit)), np.float32)
    x[: vectors.shape[1]] = unit.T
    x = hadamard(x * signs(0))  # the first round serves all
    for t in range(count):
        yield hadamard(hadamard(x * signs(1, t)) * signs(2, t))


def keys(vectors: np.ndarray, tables: int, depth: int, seed: int) -> np.ndarray:
    """The code of each vector in each table, as (row, table)."""
    out, n2 = np.empty((len(vectors), tables), np.uint64), 0
    for t, x in enumerate(rotations(vectors, tables * depth, seed)):
        axis = np.abs(x).argmax(0)
        axis = axis + np.where(x[axis, np.arange(x.shape[1])] < 0, len(x), 0)
        n2 = 2 * len(x)
        out[:, t // depth] = axis if t % depth == 0 else out[:, t // depth] * np.uint64(n2) + axis.astype(np.uint64)
    return spread(out, vectors.shape[1])


def probe_keys(vectors: np.ndarray, tables: int, depth: int, probes: int, seed: int) -> np.ndarray:
    """The codes to probe, as (row, table, probe): those whose axes lie least beyond the nearest, by sums of squares."""
    out, row = [], np.arange(len(vectors))[:, None]
    code = far = None
    for t, x in enumerate(rotations(vectors, tables * depth, seed)):
        both = np.concatenate([x, -x]).T
        most = min(PROBE_AXES, both.shape[1])
        axis = np.argpartition(-both, most - 1, axis=1)[:, :most]
        own = (both.max(1, keepdims=True) - both[row, axis]) ** 2
        if t % depth == 0:
            code, far = axis.astype(np.uint64), own
        else:
            code = (code[:, :, None] * np.uint64(both.shape[1]) + axis[:, None, :].astype(np.uint64)).reshape(len(x.T), -1)
            far = (far[:, :, None] + own[:, None, :]).reshape(len(x.T), -1)
        if far.shape[1] > probes:
            best = np.argpartition(far, probes - 1, axis=1)[:, :probes]
            code, far = code[row, best], far[row, best]
        if t % depth == depth - 1:
            out.append(code)
    wide = max(c.shape[1] for c in out)
    return spread(np.stack([np.pad(c, ((0, 0), (0, wide - c.shape[1])), mode="edge") for c in out], 1), vectors.shape[1])


def spread(code: np.ndarray, dim: int) -> np.ndarray:
    """Codes of all tables and vector lengths as 64-bit keys of one space."""
    table_no = np.arange(code.shape[1], dtype=np.uint64).reshape(1, -1, *[1] * (code.ndim - 2))
    x = code * np.uint64(0x9E3779B97F4A7C15) + table_no * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(dim * 0x94D049BB133111EB % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of the batch whose vectors have the same length, with those as an array."""
    sizes = np.diff(np.asarray(batch.column(batch.schema.names.index("v")).offsets))
    for _, i in cut_by(np.argsort(sizes, kind="stable"), sizes):
        for j in range(0, len(i), 2048):
            part = batch.take(pa.array(i[j : j + 2048]))
            flat = part.column(part.schema.names.index("v")).flatten().to_numpy()
            yield part, flat.astype(np.float64).reshape(len(part), -1)


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


CODES = "g int, keys binary, nids binary"
HITS = "qb int, asked long, nids binary"
LISTS = "b int, asked long, v binary, nids binary"
FOUND = "asked long, vec_id long, score double"


def _coded(tables: int, depth: int, groups: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, x in _by_length(whole):
                key, nid = keys(x, tables, depth, seed).ravel(), np.repeat(batch.column(0).to_numpy(), tables)
                g = (key % np.uint64(groups)).astype(np.int64)
                yield _packed([(i, key[at].tobytes(), nid[at].tobytes()) for i, at in cut_by(np.argsort(g, kind="stable"), g)], CODES)

    return run


def _probed(tables: int, depth: int, probes: int, groups: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for big, vectors in _by_length(whole):
                for j in range(0, len(big), 64):
                    batch, x = big.slice(j, 64), vectors[j : j + 64]
                    key = probe_keys(x, tables, depth, probes, seed).reshape(len(x), -1)
                    nid = np.repeat(batch.column(0).to_numpy(), key.shape[1])
                    key = key.ravel()
                    g = (key % np.uint64(groups)).astype(np.int64)
                    yield _packed([(i, key[at].tobytes(), nid[at].tobytes()) for i, at in cut_by(np.argsort(g, kind="stable"), g)], CODES)

    return run


def _column(group: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in group.column(name).to_pylist() if x), dtype)


def _meeting(blocks: int):
    """Of one group of codes: the vectors that each query meets, by block of queries."""

    def run(index: pa.Table, probe: pa.Table) -> pa.Table:
        key, nid = _column(index, "keys", np.uint64), _column(index, "nids", np.int64)
        asked_key, asked = _column(probe, "keys", np.uint64), _column(probe, "nids", np.int64)
        order = np.argsort(key)
        key, nid = key[order], nid[order]
        rows = []
        for q, i in cut_by(np.argsort(asked, kind="stable"), asked):
            lo, hi = np.searchsorted(key, asked_key[i], "left"), np.searchsorted(key, asked_key[i], "right")
            found = nid[ragged(lo, hi - lo)]
            if len(found):
                rows.append((q % blocks, q, found.tobytes()))
        return pa.Table.from_batches([_packed(rows, HITS)])

    return run


def _listing(k: int, least: int, blocks: int):
    """Of one block of queries: the vectors that meet each in ``least`` tables (fewer, if these are too few), by block
    of vectors; null stands for all vectors of the block."""

    def run(queries: pa.Table, hits: pa.Table) -> pa.Table:
        met: dict[int, list[bytes]] = {}
        for q, found in zip(hits.column("asked").to_pylist(), hits.column("nids").to_pylist()):
            met.setdefault(q, []).append(found)
        rows = []
        for q, v in zip(queries.column("nid").to_pylist(), queries.column("v").to_pylist()):
            nid, n = np.unique(np.frombuffer(b"".join(met.pop(q, [])), np.int64), return_counts=True)
            raw = np.array(v, np.float64).tobytes()
            level = next((m for m in range(least, 0, -1) if (n >= m).sum() > k), 0)
            if not level:
                rows += [(b, q, raw, None) for b in range(blocks)]
                continue
            chosen = nid[n >= level]
            b = chosen % blocks
            rows += [(i, q, raw, chosen[at].tobytes()) for i, at in cut_by(np.argsort(b, kind="stable"), b)]
        return pa.Table.from_batches([_packed(rows, LISTS)])

    return run


def _nearest(k: int):
    """Of one block of vectors: the k + 1 best ids of each query, by exact distance, then id; one row for each id."""

    def run(nodes: pa.Table, lists: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        order = np.argsort(nodes.column("nid").to_numpy())
        nodes = nodes.take(pa.array(order))
        nid, ids = nodes.column("nid").to_numpy(), nodes.column("ids").to_pylist()
        sizes = nodes.column("dim").to_numpy()
        arrays = {d: np.array(nodes.filter(pa.array(sizes == d)).column("v").to_pylist(), np.float64) for d in np.unique(sizes).tolist()} if len(nodes) else {}
        place = np.empty(len(nodes), np.int64)
        for d in arrays:
            place[sizes == d] = np.arange(int((sizes == d).sum()))
        for q, raw, chosen in zip(*(lists.column(c).to_pylist() for c in ("asked", "v", "nids"))):
            v = np.frombuffer(raw, np.float64)
            at = np.arange(len(nid)) if chosen is None else np.searchsorted(nid, np.frombuffer(chosen, np.int64))
            at = at[sizes[at] == len(v)]
            if not len(at):
                continue
            score = np.sqrt(((arrays[len(v)][place[at]] - v) ** 2).sum(1))
            best: dict[int, float] = {}
            by, last = np.argsort(score, kind="stable"), np.inf
            for j in by:
                if len(best) > k and score[j] > last:
                    break
                last = score[j]
                for i in ids[at[j]]:
                    best.setdefault(i, float(score[j]))
            out += [(q, i, s) for s, i in sorted((s, i) for i, s in best.items())[: k + 1]]
        q, i, s = (list(x) for x in zip(*out)) if out else ([], [], [])
        return pa.table({"asked": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part; equal rows once."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & (F.size(v) > 0))
    return rows.filter(F.forall(v, finite) & F.exists(v, lambda x: x != 0)).distinct()


def code_probes(n: int) -> int:
    """Codes to probe in a table for n vectors."""
    return max(8, round(PROBES * min(1.0, (PROBED / n) ** (1 / 3))))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int | None = None, least: int | None = None, seed: int = 11
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows found, by Euclidean distance of the original
    vectors in double precision, ties to the smaller id.

    ``probes``: codes probed in a table (by default as many as the rows ask for); ``least``: the tables in which a row must
    meet a query to be compared with it. Rows with the query's own id are no candidates; rows that repeat an id and a vector count once, an
    id with several vectors by its nearest. Vectors that are null, empty, zero, or hold a null or non-finite component
    take no part, nor does a null id; vectors are compared with those of their own length. Every query returns ``k``
    rows if there are as many. Extra columns are not read; an empty table gives no rows.
    """
    node = F.xxhash64("v").alias("nid")
    rows = _clean(vectors, key, vector).withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= k + 1)
    nodes = staged(rows.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(node, "v", F.size("v").alias("dim"), "ids"), "vectors")
    asked = staged(_clean(queries, key, vector).select("id", "v", node), "query-vectors")
    n = nodes.count()
    if not n:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    axes = 2 * max(1, 1 << max(0, int(nodes.agg(F.max("dim")).first()[0]) - 1).bit_length())
    depth, limit = 2, TWO_ROTATIONS
    probes = code_probes(n) if probes is None else probes
    while n > limit:
        depth, limit, probes = depth + 1, limit * axes, probes * GROWTH
    least = (LEAST if n > FEW else 2) if least is None else least
    groups, blocks = max(1, n * tables // GROUP_CODES), -(-n // BLOCK)
    per_query = max(1.0, tables * probes * n / float(axes) ** depth)
    distinct = asked.select("nid", "v").distinct()
    query_blocks = int(max(1, distinct.count() / max(1, min(QUERIES, COUNTED / per_query))))
    index = nodes.select("nid", "v").mapInArrow(_coded(tables, depth, groups, seed), CODES)
    probe = distinct.mapInArrow(_probed(tables, depth, probes, groups, seed), CODES)
    hits = index.groupBy("g").cogroup(probe.groupBy("g")).applyInArrow(_meeting(query_blocks), HITS)
    by_block = distinct.withColumn("qb", F.pmod("nid", F.lit(query_blocks)).cast("int"))
    lists = by_block.groupBy("qb").cogroup(hits.groupBy("qb")).applyInArrow(_listing(k, least, blocks), LISTS)
    placed = nodes.withColumn("b", F.pmod("nid", F.lit(blocks)).cast("int"))
    found = placed.groupBy("b").cogroup(lists.groupBy("b")).applyInArrow(_nearest(k), FOUND)
    best = found.groupBy("asked", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("asked").orderBy("score", "vec_id")
    best = staged(best.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n"), "neighbours")
    answers = asked.select(F.col("id").alias("query_id"), F.col("nid").alias("asked")).join(best, "asked").filter("vec_id <> query_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # an id may ask with several vectors
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_cross_polytope(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
