"""Streams over several batches: state must carry from one to the next."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skylark.streaming import streams, tables


@pytest.fixture
def feed(spark, tmp_path):
    """Makes a stream of the given batches, one file each, in order."""

    def make(batches, schema):
        at = tmp_path / "in"
        for i, rows in enumerate(batches, len(list(at.glob("b*")))):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(at / f"b{i}"))
        return streams.read_files(spark, f"{at}/*", spark.createDataFrame([], schema).schema)

    return make


def run(query):
    query.start().awaitTermination()


def batches_of(spark, path):
    return spark.read.parquet(path).select("batch").distinct().count()


def written(spark, path):
    return spark.read.parquet(f"{path}/batch=*").collect()


def test_first_of_key_never_repeats(spark, feed, tmp_path):
    """Keys stay known over batches and restarts, null and late ones included, and a batch reads no batch before."""
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "k string, v int"
    for rows in ([("a", 1), ("a", 2), ("b", 1), (None, 1)], [("a", 3), ("c", 1)], [("b", 9), ("c", 2), ("d", 1), (None, 2)]):
        run(streams.first_of_key(feed([rows], schema), ["k"], out, cp))  # each a restart
        for folder in tmp_path.glob("out/batch=*"):
            keys = [r.k for r in spark.read.parquet(str(folder)).collect()]
            assert len(keys) == len(set(keys))
    assert sorted(r.k or "" for r in written(spark, out)) == ["", "a", "b", "c", "d"]


def test_work_of_a_batch_does_not_grow(spark, feed, tmp_path):
    """Over many files, each batch reads its own rows only."""
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    rows = feed([[(f"k{i * 7 + j}", j) for j in range(10)] for i in range(12)], "k string, v int")
    query = streams.first_of_key(rows, ["k"], out, cp).start()
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert read == [10] * 12 and len(written(spark, out)) == 11 * 7 + 10


def test_dedup_forgets_and_counts_late_rows(spark, feed, tmp_path):
    day = lambda d: f"2026-01-{d:02d} 00:00:00"
    rows = feed([[("a", day(1)), ("a", day(2))], [("b", day(20))], [("b", day(21))], [("a", day(19)), ("c", day(3))]], "k string, at string")  # rows count as late by the watermark of two batches before
    out = streams.dedup_stream(rows.select("k", F.to_timestamp("at").alias("ts")), ["k"], late="5 days")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.k, r.ts.day) for r in spark.read.parquet(str(tmp_path / "o")).collect()) in ([("a", 1), ("a", 19), ("b", 20)], [("a", 2), ("a", 19), ("b", 20)])
    assert streams.late_rows(query) == 1


def test_crawl_diff_carries_its_state(spark, feed, tmp_path):
    """Three runs, so two restarts; what is known stays in the state store."""
    schema, out, cp = "site string, url string, lastmod string", str(tmp_path / "out"), str(tmp_path / "cp")
    state = spark.createDataFrame([("s", "old", "0"), ("m", "old", "0")], schema)
    for rows in ([("s", "u1", "1"), ("s", "u2", None), ("m", "w", "1")], [("s", "u1", "1"), ("s", "u2", "2"), ("n", "x", "1"), ("n", "y", "2")], [("s", "u1", "3"), ("m", "w", "9"), ("s", "u3", None), ("n", "z", "1")]):
        run(streams.crawl_diffs(feed([rows], schema), state, out, cp, ("m",), first_run=1))
    got = sorted((r.site, r.url, r.lastmod or "", r.known_site) for r in written(spark, f"{out}/new"))
    assert got == [("m", "w", "1", True), ("n", "y", "2", False), ("n", "z", "1", True), ("s", "u1", "1", True), ("s", "u1", "3", True), ("s", "u2", "", True), ("s", "u3", "", True)]  # a stored "seen" sorts above any date
    last = {(r.site, r.url): r.lastmod for r in streams.crawl_state(spark, cp).collect()}
    assert last == {("s", "old"): "0", ("m", "old"): "0", ("s", "u1"): "3", ("s", "u2"): "2", ("s", "u3"): "seen", ("m", "w"): "9", ("n", "x"): "1", ("n", "y"): "2", ("n", "z"): "1"}
    assert sorted(f.name for f in (tmp_path / "out" / "sites").glob("version=*")) == ["version=1", "version=2"]  # older ones are gone


def test_topics_merge_over_batches(spark, feed, tmp_path):
    schema = "title string, category string, score int, date string, ord int"
    rows = feed([[("One ", "a", 5, "2026-01-02", 2), ("two", "a", 1, "2026-01-01", 1)], [("one", "b", 3, "2026-01-03", 3)], [("ONE", "c", 4, "2026-01-01", 0)]], schema)
    run(streams.merge_topics(rows, str(tmp_path / "t"), str(tmp_path / "cp")))
    got = {r.topic_id: (r.name, r.category, r.total_score, r.mention_count, r.first_seen, r.last_seen) for r in tables.current(spark, str(tmp_path / "t")).collect()}
    assert got == {"one": ("one", "b", 5, 3, "2026-01-01", "2026-01-03"), "two": ("two", "a", 1, 1, "2026-01-01", "2026-01-01")}


def test_daily_top_closes_days(spark, feed, tmp_path):
    schema, t, cp = "ts timestamp, title string, score int, src_ord int, item_ord long", str(tmp_path / "t"), str(tmp_path / "cp")
    at = lambda d: dt.datetime(2026, 1, d, 12)
    batches = [[(at(1), f"t{i}", i, 0, i) for i in range(5)], [(at(1), "best", 99, 1, 0), (at(1), "tie", 4, 1, 1)], [(at(9), "x", 1, 0, 0), (None, "when", 1, 0, 9)], [(at(1), "late", 100, 2, 2), (at(9), "y", 5, 2, 3)]]
    for rows in batches:
        run(streams.daily_top(feed([rows], schema), t, cp, keep=("title",), limit=3))
    got = tables.current(spark, t).orderBy("day", "rank").collect()
    assert [(r.day, r["rank"], r.title) for r in got] == [("2026-01-01", 1, "best"), ("2026-01-01", 2, "t4"), ("2026-01-01", 3, "tie"), ("2026-01-09", 1, "y"), ("2026-01-09", 2, "x")]
    assert sorted(r.title for r in written(spark, f"{t}/late")) == ["late", "when"]
    heads = spark.read.parquet(f"{t}/heads/version=3").collect()
    assert {r.bucket: r.version for r in heads} == {"2026-01-01": 1, "2026-01-09": 3}  # the closed day is as batch 1 left it


def test_upserts_rewrite_their_own_buckets(spark, tmp_path):
    """A batch of one key in a hundred rewrites about its own buckets; older versions go; a batch that runs again, or
    after a crash before its heads were written, ends in the same table."""
    at, key = str(tmp_path / "u"), tables.by_key(["k"], 50)
    last = lambda rows: rows.groupBy("k").agg(F.max_by("v", "_new").alias("v"))
    put = lambda n, rows: tables.merge(spark.createDataFrame(rows, "k int, v int"), at, n, key, last, fresh="_new")
    everything = {k: k for k in range(1000)}
    assert len(put(0, list(everything.items()))) == 50
    few = {k: -k for k in range(0, 1000, 100)}
    for epoch in (1, 1, 2):
        touched = put(epoch, list(few.items()))
        assert len(touched) <= len(few)
        written = [f for f in tmp_path.glob(f"u/data/version={epoch}/bucket=*")]
        assert sorted(f.name.partition("=")[2] for f in written) == touched
        assert {r.k: r.v for r in tables.current(spark, at).collect()} == everything | few
    assert sorted(f.name for f in tmp_path.glob("u/heads/version=*")) == ["version=1", "version=2"]
    assert len(list(tmp_path.glob("u/data/version=0/bucket=*"))) == 50 - len(touched)  # what was replaced twice is gone
    (tmp_path / "u" / "heads" / "version=2" / "_SUCCESS").unlink()  # as if batch 2 had crashed
    assert {r.k: r.v for r in tables.current(spark, at).collect()} == everything | few
    put(2, [(5, 50)])
    assert {r.k: r.v for r in tables.current(spark, at).collect()} == everything | few | {5: 50}


def test_latest_values(spark, feed, tmp_path):
    rows = feed([[("a", 1)], [("a", 2), ("b", 1)]], "k string, v int")
    totals = rows.groupBy("k").agg(F.sum("v").alias("v"))
    run(streams.upsert_sink(totals, ["k"], str(tmp_path / "r"), str(tmp_path / "cp")))
    assert {(r.k, r.v) for r in tables.current(spark, str(tmp_path / "r")).collect()} == {("a", 3), ("b", 1)}


def test_a_batch_is_written_by_as_many_tasks_as_its_share_needs(spark):
    """However large the table, no task writes or reads a whole batch of it."""
    from skylark.plans import store_queries as Q

    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scanned = Q.table(spark, "/root/testdata/sf0.001", "documents").rdd.getNumPartitions()
        rows = Q._stream(spark, "/root/testdata/sf0.001", "documents")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    sizes = []
    rows.select("doc_id", "_metadata").writeStream.foreachBatch(lambda b, n: sizes.append((b.count(), b.select("_metadata.file_path").distinct().count()))).trigger(availableNow=True).start().awaitTermination()
    assert scanned > Q.BATCHES and len(sizes) == Q.BATCHES and sum(n for n, _ in sizes) == Q.table(spark, "/root/testdata/sf0.001", "documents").count()
    assert all(n == -(-scanned // Q.BATCHES) for _, n in sizes)
