from __future__ import annotations

from skylark.sources import landed, sinks


def test_dates_are_replaced(spark, tmp_path):
    path = str(tmp_path / "pool")
    rows = lambda *x: spark.createDataFrame(list(x), "date string, title string, score int")
    sinks.overwrite_dates(rows(("2026-01-01", "a", 1), ("2026-01-02", "b", 2)), path)
    sinks.overwrite_dates(rows(("2026-01-02", "c", 3)), path)
    assert {(str(r.date), r.title) for r in spark.read.parquet(path).collect()} == {("2026-01-01", "a"), ("2026-01-02", "c")}


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01", "ai-hn", "# x\ny"), ("2026-01-01", "ai-web", "z")], "date string, report_type string, content string")
    sinks.write_reports(df, str(tmp_path / "r"))
    back = spark.read.text(str(tmp_path / "r"), wholetext=True)
    assert {(r.report_type, r.value.strip()) for r in back.collect()} == {("ai-hn", "# x\ny"), ("ai-web", "z")}


def test_pool_and_catalogue_files(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01", "a", 1)], "date string, title string, score int")
    sinks.write_pool(df, str(tmp_path / "p"))
    assert [(r.title, r.score) for r in landed.scan_json(spark.read, str(tmp_path / "p"), "title string, score int").collect()] == [("a", 1)]
    sinks.write_small_json(df, str(tmp_path / "m"))
    sinks.write_table(df, str(tmp_path / "t"), ("title",))
    sinks.append_chunks(df, str(tmp_path / "c"))
    sinks.append_chunks(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1 == spark.read.parquet(str(tmp_path / "t")).count()
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_broken_files_are_set_aside(spark, tmp_path):
    pools, reports = tmp_path / "pools", tmp_path / "reports"
    for day, text in (("2026-01-01", '{"candidates": [{"topic": "t", "score": 3}]}'), ("2026-01-02", '{"candidates": [{'), ("2026-01-03", '{"items": []}'), ("2026-01-04", "")):
        (pools / f"date={day}").mkdir(parents=True)
        (pools / f"date={day}" / "pool.json").write_text(text)
    bad = {r.path.split("date=")[1][:10]: r.reason for r in landed.quarantined_pools(spark.read, str(pools)).collect()}
    assert bad == {"2026-01-02": "not JSON", "2026-01-03": "no candidates"} or bad == {"2026-01-02": "not JSON", "2026-01-03": "no candidates", "2026-01-04": "not JSON"}
    assert [r.title for r in landed.scan_pool(spark.read, str(pools)).collect()] == ["t"]
    for name, data in (("2026-01-01/ai-hn.md", "gut é".encode()), ("2026-01-01/ai-web.md", b" \n"), ("2026-01-01/ai-ph.md", b"caf\xe9"), ("drafts/ai-hn.md", b"x")):
        (reports / name).parent.mkdir(parents=True, exist_ok=True)
        (reports / name).write_bytes(data)
    bad = {r.path.rsplit("/", 1)[1] + r.reason for r in landed.quarantined_reports(spark, str(reports)).collect()}
    assert bad == {"ai-web.mdblank", "ai-ph.mdnot UTF-8", "ai-hn.mdno date"}
