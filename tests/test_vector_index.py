"""The stored vector index against exact search."""

from __future__ import annotations

import numpy as np

from skylark.operators import retrieval, vector_index

VECTORS = "vec_id long, embedding array<double>"


def _frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def _found(df):
    return {(r.query_id, r.rank): r.vec_id for r in df.collect()}


def test_clustered_vectors_ask_few_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector_index, "GROUP_QUERIES", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16))
    x = centre[np.where(np.arange(2400) % 3 == 0, 0, rng.integers(0, 40, 2400))] + 0.15 * rng.normal(size=(2400, 16))  # a third lies in one place
    e = _frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    index = vector_index.build(e, str(tmp_path / "index"))
    assert index.recall >= 0.95 and index.probes <= len(index.centres) // 4
    assert sum(index.blocks.values()) > len(index.blocks)  # large cells are cut
    assert sorted(r.vec_id for r in vector_index.stored_rows(spark, index).select("vec_id").collect()) == list(range(2400))
    queries = e.filter("vec_id % 50 = 0")
    exact, got = _found(retrieval.vector_topk_batch(e, queries, 10)), _found(vector_index.nearest(index, queries, 10))
    assert len(got) == len(exact) == 480
    hits = {(q, v) for (q, _), v in got.items()} & {(q, v) for (q, _), v in exact.items()}
    assert len(hits) >= 0.9 * len(exact)
    assert _found(vector_index.nearest(index, queries, 10, probes=len(index.centres))) == exact


def test_odd_vectors(spark, tmp_path):
    """Ties, equal vectors, other lengths, and rows without a distance; queries that the index does not hold."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x[20:30] = x[20]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [1.0, 2.0]), (1003, [2.0, 4.0]), (1004, [None] + [1.0] * 7), (1005, [float("nan")] * 8), (None, [1.0] * 8)]
    e = _frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + odd)
    index = vector_index.build(e, str(tmp_path / "index"))
    every = len(index.centres)
    assert _found(vector_index.nearest(index, e, 10, probes=every)) == _found(retrieval.vector_topk_batch(e, e, 10))
    alone = _frame(spark, [(5000, [1.0] * 3), (5001, [3.0, 6.0])])
    assert _found(vector_index.nearest(index, alone, 10)) == {(5001, 1): 1002, (5001, 2): 1003}


def test_empty_tables(spark, tmp_path):
    none, one = _frame(spark, []), _frame(spark, [(1, [1.0, 0.0])])
    index = vector_index.build(none, str(tmp_path / "none"))
    assert vector_index.nearest(index, one, 3).count() == 0
    index = vector_index.build(one, str(tmp_path / "one"))
    assert vector_index.nearest(index, none, 3).count() == 0
    assert vector_index.nearest(index, one, 3).count() == 0  # but the query's own
