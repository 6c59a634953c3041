from __future__ import annotations

import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylark.operators import assembly, catalog, crawl, graph, ranking, retrieval, scoring, store
from skylark.sources import landed

SIGNAL = "title string, url string, source string, source_type string, summary string, published_at string, heat_signals array<double>, tags array<string>, src_ord int, item_ord long"


def test_the_worked_score(spark):
    tagline = "Automate enterprise workflow with agents, pricing for teams included"
    row = ("Agent Suite", "https://x", "Product Hunt", "product", tagline, "2026-05-30T00:30:00Z", [360.0, 80.0], ["agents"], 3, 1)
    out = scoring.score_signals(spark.createDataFrame([row], SIGNAL), F.lit("2026-05-30 02:00:00").cast("timestamp")).first()
    assert (out.heat, out.freshness) == (30, 20) and out.action in ("深挖", "入池")
    assert out.evidence == ["来源：Product Hunt", "热度信号：360 / 80", "发布时间：2026-05-30", "关键词：agents"]
    assert out.reason.endswith("来源：Product Hunt。") and out.recommended_topic.startswith("Agent Suite 为什么值得关注？（")


def test_scores_stay_in_bounds_and_bad_rows_survive(spark):
    rows = [(None, None, "s", "github", None, "never", None, None, 0, 1), ("模型 监管", "u", "s", "official", "x" * 90, "2099-01-01", [1e9], ["a", None, ""], 1, 2)]
    out = {r.item_ord: r for r in scoring.score_signals(spark.createDataFrame(rows, SIGNAL), F.lit("2026-01-01").cast("timestamp")).collect()}
    for r in out.values():
        assert 0 <= r.commercial_impact <= 40 and 0 <= r.heat <= 30 and 0 <= r.freshness <= 20 and 0 <= r.writability <= 10
    assert out[1].freshness == 12 and out[2].freshness == 20 and out[2].category.startswith("政策") and out[2].tags == ["a"]
    assert "值得关注的三个信号" in out[2].recommended_topic


def test_ranking(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1), (4, "b", 1)], "id int, g string, v int")
    assert {r.id for r in ranking.keep_first(df, ["g"], ["id"]).collect()} == {1, 3}
    assert [r.id for r in ranking.early_cut(df, 3, ["id"], [F.desc("v"), "id"]).collect()] == [2, 1, 3]
    assert {(r.g, r.id) for r in ranking.top_per_group(df, "g", {"a": 1}, [F.desc("v")]).collect()} == {("a", 2)}
    assert [r.id for r in ranking.page(df, ["id"], 1, 2).collect()] == [2, 3]


def test_chunks():
    assert retrieval.chunks_of(None) == [] == retrieval.chunks_of("  ")
    with pytest.raises(ValueError):
        retrieval.chunks_of("x", 10, 10)
    long = retrieval.chunks_of("ab" * 1000)
    assert [len(c) for c in long] == [1000, 1000, 400] and long[0][800:] == long[1][:200]
    parts = retrieval.chunks_of("## One\n" + "a" * 900 + "\n\n" + "b" * 300 + "\n## Two\n" + "c" * 50 + "\n### not a cut")
    assert len(parts) == 3 and parts[2].startswith("## Two") and all(20 < len(p) <= 1000 for p in parts)


def test_packed_blocks():
    text = "\n".join(f"## s{i}\n" + "x" * 300 for i in range(30))
    out = assembly.packed_blocks(text, 1000)
    assert len(out) > 1 and all(len(b) <= 1000 for b in out) and "\n".join(out) == text
    assert assembly.packed_blocks("short", 1000) == ["short"]


def test_fusion_keeps_the_first_list(spark):
    ranked = spark.createDataFrame([(0, 0, "a", "v"), (0, 1, "b", "v"), (1, 0, "b", "g"), (1, 1, "c", "g")], "list_ord int, rank0 int, key string, source string")
    out = retrieval.rrf(ranked, 5).collect()
    assert [r.key for r in out] == ["b", "a", "c"] and out[0].source == "v" and out[0].score == round(1 / 62 + 1 / 61, 6)


def test_crawl(spark):
    found = spark.createDataFrame([("a", "u1", "2"), ("a", "u2", None), ("b", "v1", "9"), ("b", "v2", None), ("m", "w", "5")], "site string, url string, lastmod string")
    state = spark.createDataFrame([("a", "u1", "1"), ("m", "w", "1"), ("z", "old", "3")], "site string, url string, lastmod string")
    new = crawl.crawl_diff(found, state, ("m",), first_run=1)
    assert {(r.site, r.url, r.known_site) for r in new.collect()} == {("a", "u1", True), ("a", "u2", True), ("b", "v1", False)}
    after = {(r.site, r.url): r.lastmod for r in crawl.next_state(found, state).collect()}
    assert after[("a", "u2")] == "seen" and after[("z", "old")] == "3" and after[("a", "u1")] == "2"
    empty = crawl.crawl_diff(found.limit(0), state)
    assert empty.count() == 0


def test_store(spark):
    base = spark.createDataFrame([(1, "x", "c1"), (2, "y", "c2")], "id int, name string, created_at string")
    out = {r.id: r for r in store.patch(base, spark.createDataFrame([(1, "z", "no")], base.schema), "id").collect()}
    assert out[1].name == "z" and out[1].created_at == "c1" and out[2].name == "y"
    with pytest.raises(KeyError):
        store.patch(base, spark.createDataFrame([(9, "z", "no")], base.schema), "id")
    got = spark.createDataFrame([('{"a":"1"}',), ("bad",), (None,)], "j string").select(store.config_from_json(F.col("j")).alias("m")).collect()
    assert [r.m for r in got] == [{"a": "1"}, {}, {}]


def test_graph_is_idempotent(spark):
    rows = [("T one ", "c", "2026-01-01", 50, "观察", "s1", ["ab", "x"], 1), ("t ONE", "d", "2026-01-02", 80, "深挖", "s2", ["ab"], 2)]
    app = spark.createDataFrame(rows, "title string, category string, date string, score int, action string, source string, tags array<string>, ord int")
    t = graph.topics(app).collect()
    assert len(t) == 1 and (t[0].total_score, t[0].mention_count, t[0].name, t[0].category) == (80, 2, "t ONE", "d")
    assert graph.mentions(app).count() == 1  # "x" is too short
    assert {r.direction for r in graph.trend(app, "one", F.lit("2026-01-01").cast("date")).collect()} == {"up"}
    with pytest.raises(ValueError):
        graph.daily_overview(app, "2026/01/01")


def test_monthly_takes_every_fourth_day(spark):
    rows = [(i, f"2026-01-{i:02d}", "ai-hn", "t") for i in range(1, 11)]
    out = catalog.monthly(spark.createDataFrame(rows, "doc_id int, date string, report_type string, content string"), "2026-01")
    assert sorted(r.date for r in out.collect()) == ["2026-01-02", "2026-01-06", "2026-01-10"]


def test_feeds(spark):
    rss = "<rss><item><title><![CDATA[AI news]]></title><link>http://a</link><description>&lt;b&gt;x</description></item><item><title>no link</title></item></rss>"
    got = landed.rss_items(spark.createDataFrame([(rss,)], "value string")).collect()
    assert [(r.title, r.link, r.guid, r.summary) for r in got] == [("AI news", "http://a", "http://a", "<b>x")]
    atom = '<feed><entry><id>http://p/abs/1</id><title>A\n B</title><summary> s </summary><author><name>N</name></author><category term="cs.AI"/></entry></feed>'
    p = landed.atom_entries(spark.createDataFrame([(atom,)], "value string")).first()
    assert (p.title, p.summary, p.authors, p.categories, p.pdf_url) == ("A B", "s", ["N"], ["cs.AI"], "http://p/pdf/1")
    page = '<article class="Box-row"><h2 class="h3"><a href="/o/r"></a></h2><p class="col-9 x">d <b>e</b></p><span itemprop="programmingLanguage">Go</span> 1,234 stars today</article><article class="Box-row">nothing</article>'
    t = landed.trending_blocks(spark.createDataFrame([(page,)], "value string")).collect()
    assert [(r.full_name, r.description, r.language, r.today_stars) for r in t] == [("o/r", "d e", "Go", 1234)]
    assert landed.sitemap_urls(spark.createDataFrame([("",)], "value string")).count() == 0


def test_scans_skip_corrupt_files(spark, tmp_path):
    for date, body in (("2026-01-01", json.dumps({"candidates": [{"topic": "T", "score": 3}]})), ("2026-01-02", "{broken")):
        (tmp_path / f"date={date}").mkdir()
        (tmp_path / f"date={date}" / "pool.json").write_text(body)
        (tmp_path / f"date={date}" / "ai-hn.md").write_text("# x")
        (tmp_path / f"date={date}" / "ai-hn-en.md").write_text("# y")
    pool = landed.scan_pool(spark.read.option("pathGlobFilter", "*.json"), str(tmp_path)).collect()
    assert [(str(r.date), r.title, r.score) for r in pool] == [("2026-01-01", "T", 3)]
    reports = landed.scan_reports(spark, str(tmp_path)).collect()
    assert {(r.date, r.report_type) for r in reports} == {("2026-01-01", "ai-hn"), ("2026-01-02", "ai-hn")}


def test_vector_topk_batch_asks_all_queries(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    x[300:340] = x[300]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [1.0, 2.0]), (1003, [2.0, 4.0]), (1004, [None] + [1.0] * 7)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in retrieval.vector_topk_batch(e, e.filter("vec_id % 2 = 0 OR vec_id = 1003"), 10, group_rows=250, group_queries=100).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 12)
    np.fill_diagonal(d, np.inf)
    want = {q: {i + 1: int(v) for i, v in enumerate(np.lexsort((np.arange(900), d[q]))[:10])} for q in range(0, 900, 2)}
    assert got == want | {1002: {1: 1003}, 1003: {1: 1002}}


def test_vector_topk_batch_is_exact(spark):
    from skylark.plans import QUERIES

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        d = 1 - unit @ unit[i]
        d[i] = np.inf
        want |= {(int(ids[i]), int(ids[j]), n + 1) for n, j in enumerate(np.lexsort((ids, d))[:10])}
    assert {tuple(r) for r in QUERIES["vector_topk_batch"](spark, "/root/testdata/sf0.01").collect()} == want


def test_repositories_are_cut_before_they_move(spark):
    """The rank's limit is a number, so each task passes on few rows, and bodies are not sorted."""
    rows = [(i, "open" if i % 2 else "closed", "a", ("r1", "r2", "other")[i % 3], i % 4 == 0, i % 7, "t", "b" * (i % 50)) for i in range(400)]
    items = spark.createDataFrame(rows, "number long, state string, login string, repo string, is_pr boolean, comments long, title string, body string")
    items = items.select("*", F.struct("login").alias("user"), F.lit(None).cast("array<struct<name:string>>").alias("labels"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at"), F.lit(None).cast("struct<`+1`:int>").alias("reactions"), F.lit("https://github.com/o/r/issues/1").alias("html_url"))
    repos = spark.createDataFrame([("r1",), ("r2",), ("quiet",)], "repo string")
    out = assembly.repo_context(items, repos, 5, 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.repo: r.context for r in out.collect()}
    assert got["quiet"] == "No activity" and set(got) == {"r1", "r2", "quiet"}
    for repo in ("r1", "r2"):
        own = sorted((r for r in rows if r[3] == repo), key=lambda r: (r[4], -r[5], r[0]))
        want = [r[0] for r in own if not r[4]][:5] + [r[0] for r in own if r[4]][:3]
        assert [int(x) for x in re.findall(r"^#(\d+) ", got[repo], re.M)] == want


def test_terms_are_weighed_in_blocks(spark, monkeypatch):
    """Weights as reckoned by hand, in one block and in many; no row for each word of a text is moved."""
    monkeypatch.setattr(retrieval, "BLOCK_CHARS", 40)
    texts = [(f"k{i}", " ".join(("a", "B", f"w{i % 5}", "b", "x" * (i % 3 + 1))[: i % 6])) for i in range(30)] + [("none", None)]
    df = spark.createDataFrame(texts, "chunk_id string, text string")
    plan = retrieval.term_vectors(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(chunk_id" not in plan
    words = {k: t.strip().lower().split() or [""] for k, t in texts if t is not None}
    have = Counter(w for ws in words.values() for w in set(ws))
    got = {(r.chunk_id, r.term): r for r in retrieval.term_weights(df).collect()}
    assert set(got) == {(k, w) for k, ws in words.items() for w in ws}
    for k, ws in words.items():
        x = {w: ws.count(w) * math.log((len(words) + 1) / (have[w] + 1)) for w in ws}
        norm = math.sqrt(sum(v * v for v in x.values()))
        for w, v in x.items():
            r = got[k, w]
            assert r.tf == ws.count(w) and abs(r.norm - norm) < 1e-9 and abs(r.weight - (v / norm if norm else 0)) < 1e-9
    assert retrieval.term_weights(df.limit(0)).count() == 0
