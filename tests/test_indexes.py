"""Stored indexes: full text by term, and the search index by date."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skylark.operators import fulltext, graph, retrieval
from skylark.sources import sinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("alpha", "Beta", "gamma", "delta", "the", "the", "the")) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    return rows + [(100, ""), (101, None), (102, "Straße, naïve!"), (103, "alpha " * 500)]


def brute(rows, terms):
    import regex

    split = {k: regex.split(r"[^\p{L}\p{N}]+", t.lower()) for k, t in rows if t is not None}
    n, mean, out = len(split), sum(map(len, split.values())) / len(split), Counter()
    for t in terms:
        df = sum(t in w for w in split.values())
        for k, w in split.items():
            if tf := w.count(t):
                out[k] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return {k: round(v, 9) for k, v in out.items()}


def scores(df):
    return {r.doc_id: round(r.score, 9) for r in df.collect()}


def test_index_scores_like_bm25(spark, texts, tmp_path):
    df, at = spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path / "i")
    for parts in (df.filter("doc_id < 20"), df.filter("doc_id >= 20 AND doc_id < 102"), df.filter("doc_id >= 102"), df.filter("doc_id < 0")):
        fulltext.write_index(parts, at, "doc_id", "text")
    for terms in (("alpha",), ("Beta", "the", "straße"), ("missing", "gamma"), ("missing",)):
        want = brute(texts, [t.lower() for t in terms])
        assert scores(fulltext.search(spark, at, terms, "doc_id")) == want
        assert scores(fulltext.bm25(df, terms, "doc_id", "text")) == want
    assert {r.term: (r.df, r.cf) for r in fulltext.vocabulary(spark, at).filter("term = 'alpha'").collect()}["alpha"][1] == sum((t or "").split().count("alpha") for _, t in texts)


def test_search_reads_terms_and_splits_nothing(spark, texts, tmp_path):
    df, at = spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path / "i")
    fulltext.write_index(df, at, "doc_id", "text")
    shown = plan(fulltext.search(spark, at, ("alpha", "beta"), "doc_id"))
    assert "split(" not in shown and "PushedFilters: [In(term, [alpha,beta])" in shown
    ranked = lambda *terms: plan(fulltext.bm25(df, terms, "doc_id", "text").filter("score > 0.5").orderBy("score")).count("split(")
    assert ranked("alpha") == ranked("alpha", "beta", "gamma", "delta") <= 6  # however many terms are asked
    first = {f: spark.read.parquet(f).agg(F.min("term"), F.max("term")).first() for f in spark.read.parquet(f"{at}/postings").inputFiles()}
    spans = sorted(tuple(r) for r in first.values() if r[0] is not None)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # files are ranges of terms


def test_words_are_counted_in_their_row(spark, texts, tmp_path, monkeypatch):
    """Counting moves no words, and the ranges that are sorted and written grow in number with the text."""
    df, at = spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path / "i")
    rows = fulltext.postings(df, "doc_id", "text")
    assert "Exchange" not in plan(rows) and "Aggregate" not in plan(rows)
    import regex

    want = {(w, k, len(s)): n for k, t in texts if t is not None for s in [regex.split(r"[^\p{L}\p{N}]+", t.lower())] for w, n in Counter(s).items()}
    assert {(r.term, r.key, r.len): r.tf for r in rows.collect()} == want and rows.count() == len(want)
    monkeypatch.setattr(fulltext, "RANGE_CHARS", 100)
    fulltext.write_index(df, at, "doc_id", "text")
    assert len(spark.read.parquet(f"{at}/postings").inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scores(fulltext.search(spark, at, ("the", "alpha"), "doc_id")) == brute(texts, ["the", "alpha"])


def test_broken_part_is_written_over(spark, texts, tmp_path):
    df, at = spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path / "i")
    fulltext.postings(df, "doc_id", "text").write.parquet(f"{at}/postings/part=0")  # an attempt that never wrote its size
    fulltext.write_index(df, at, "doc_id", "text")
    assert scores(fulltext.search(spark, at, ("alpha",), "doc_id")) == brute(texts, ["alpha"])


SCHEMA = "date string, title string, category string, source string, reason string, evidence string, score int, item_ord long"


def test_chat_context_prunes_to_its_dates(spark, tmp_path):
    at = str(tmp_path / "s")
    rows = [(f"2026-01-{d:02d}", f"t{d}-{i} {'gpu' if i < d % 4 else 'x'}", "c", "s", "r", "e", i, d * 100 + i) for d in range(1, 21) for i in range(5)]
    index = spark.createDataFrame(rows, SCHEMA)
    sinks.write_search_index(index, at)
    stored = sinks.read_search_index(spark, at)
    got = retrieval.chat_context(stored, ("gpu",))
    assert "dynamicpruning" in plan(got)
    key = lambda df: sorted(tuple(r) for r in df.select("date", "title", "hits", "score").collect())
    assert key(got) == key(retrieval.chat_context(index, ("gpu",))) and len({r.date for r in got.collect()}) <= 3
    sinks.write_search_index(spark.createDataFrame([("2026-01-03", "new", "c", "s", "r", "e", 1, 1)], SCHEMA), at)
    back = sinks.read_search_index(spark, at)
    assert back.count() == 96 and [r.title for r in back.filter("date = '2026-01-03'").collect()] == ["new"]


def test_edges_join_without_a_shuffle(spark, tmp_path, monkeypatch):
    rows = [(f"e{i % 7}", f"t{i % 11}") for i in range(60)] + [("alone", "t99")]
    edges = spark.createDataFrame(rows, "entity_id string, topic_id string").distinct()
    graph.write_edges(edges, "edges_of_a_test", str(tmp_path / "edges"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = spark.table("edges_of_a_test")
        own = m.filter("entity_id = 'e1'").join(m.withColumnRenamed("entity_id", "other_id"), "topic_id")
        assert "SortMergeJoin" in plan(own) and "Exchange" not in plan(own)
        got = graph.entity_neighbours(m, "E1")
        assert "hashpartitioning(topic_id" not in plan(got)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in graph.entity_neighbours(edges, "e1").collect()]
        assert [tuple(r) for r in graph.entity_neighbours(m, "alone").collect()] == [("alone", "t99", "")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table edges_of_a_test")
