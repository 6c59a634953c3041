"""Normalisers of landed rows, the union of signals, item texts, report order and result lists."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skylark import rules as R
from skylark.operators import assembly, catalog, contexts, retrieval, scoring, signals
from skylark.sources import items

NOW = "2026-05-30 02:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def test_stories(spark):
    hits = spark.createDataFrame(
        [(0, "a", "A", None, 5, None, "x", "2026-05-29T20:00:00Z"), (1, "a", "again", "u", 9, 1, "y", "2026-05-29T20:00:00Z"), (2, "b", "B", "http://b", None, 3, "z", "2026-05-29T03:00:00.000Z"), (3, "old", "O", "http://o", 99, 3, "z", "2026-05-28T03:00:00Z")],
        "item_ord int, id string, title string, url string, points int, num_comments int, author string, created_at string",
    )
    got = items.stories(hits, now()).collect()
    assert [(r.id, r.title, r.url.endswith("id=a"), r.points, r.comments) for r in got] == [("a", "A", True, 5, 0), ("b", "B", False, 0, 3)]
    assert items.stories(hits, now(), limit=1).count() == 1 and items.stories(hits, limit=None).count() == 3


def test_products(spark):
    schema = "item_ord int, node struct<id:string,name:string,tagline:string,url:string,website:string,votes_count:int,comments_count:int,created_at:string,topics:struct<edges:array<struct<node:struct<slug:string,name:string>>>>>"
    node = lambda i, at, slugs, votes, site: (i, (str(i), f"n{i}", "t", f"http://{i}", site, votes, 0, at, ([((s, s.upper()),) for s in slugs],)))
    edges = spark.createDataFrame([node(0, "2026-05-28T12:00:00Z", ["games", "ai"], 3, ""), node(1, "2026-05-28T12:00:00Z", ["games"], 9, ""), node(2, "2026-05-29T12:00:00Z", ["ai"], 9, ""), node(3, "2026-05-28T13:00:00Z", ["llm"], 7, "http://site")], schema)
    got = items.products(edges, now()).collect()
    assert [(r.id, r.website, r.topics) for r in got] == [("3", "http://site", ["LLM"]), ("0", "http://0", ["GAMES", "AI"])]


def test_papers_and_models(spark):
    entry = lambda i, at: f'<entry><id>http://p/abs/{i}</id><title>T{i}</title><published>{at}</published><category term="c"/></entry>'
    feeds = spark.createDataFrame([(0, entry(1, "2026-05-29T00:00:00Z") + entry(2, "2026-05-27T00:00:00Z")), (1, entry(1, "2026-05-29T00:00:00Z") + entry(3, "2026-05-29T09:00:00Z"))], "item_ord int, value string")
    assert [r.title for r in items.papers(feeds, now()).collect()] == ["T3", "T1"]
    rows = spark.createDataFrame([(0, "org/m", None, 1, 2, None, None, None), (1, "m", "me", 1, 2, ["x"], "p", "d")], "item_ord int, id string, author string, likes int, downloads int, tags array<string>, pipeline_tag string, last_modified string")
    assert [(r.author, r.tags, r.pipeline_tag, r.last_modified) for r in items.models(rows).orderBy("item_ord").collect()] == [("org", [], "", ""), ("me", ["x"], "p", "d")]


def test_news_keeps_the_first_about_the_keywords(spark):
    item = lambda t, d="", extra="": f"<item><title><![CDATA[{t}]]></title><link>http://{len(t)}</link><description><![CDATA[{d}]]></description>{extra}</item>"
    feed = item("Metadata of chAIrs") + item("nothing") + item("plain", "<b>大模型</b> x", "<dc:creator>me</dc:creator><author>you</author>") + item("no link").replace("<link>http://7</link>", "") + item("Copilot")
    feeds = spark.createDataFrame([(feed,)], "value string")
    got = items.news(feeds, now()).collect()
    assert [(r.title, r.summary, r.author, r.published_at) for r in got] == [("Metadata of chAIrs", "", "36kr", "2026-05-30T02:00:00.000Z"), ("plain", "大模型 x", "me", "2026-05-30T02:00:00.000Z")]
    assert [r.title for r in items.news(feeds, limit=1).collect()] == ["Metadata of chAIrs"]
    assert [(r.title, r.author) for r in items.project_news(feeds).collect()] == [("Metadata of chAIrs", "OSChina"), ("plain", "you"), ("Copilot", "OSChina")]
    assert len(R.NEWS_KEYWORDS) == len(R.PROJECT_NEWS_KEYWORDS) == 20 and len(R.ARTICLE_KEYWORDS) == 14 and len(R.PROJECT_KEYWORDS) == 27


def test_articles_and_projects(spark):
    a = spark.createDataFrame(
        [(0, 0, "u0", "x", "", "about RAG", (None, ""), 0, None), (1, 5, "u5", "GPT", "http://g", None, ("n", "k"), 60, ["t"]), (2, 5, "u6", "GPT again", "", "", None, 60, None), (3, 9, "u9", "cats", "", "", None, 60, ["AIGC"]), (4, 8, "u8", "cats", "", "", None, 60, None)],
        "item_ord int, id int, uuid string, title string, url string, description string, author struct<name:string,nickname:string>, publish_time long, topics array<string>",
    )
    got = items.topic_articles(a, now()).collect()
    assert [(r.id, r.url.rsplit("/", 1)[1], r.author, r.publish_time) for r in got] == [("u0", "u0", "InfoQ", "2026-05-30T02:00:00.000Z"), ("5", "g", "k", "1970-01-01T00:01:00.000Z"), ("9", "u9", "InfoQ", "1970-01-01T00:01:00.000Z")]
    p = spark.createDataFrame([(i, i % 3, f"agent{i}", f"o/{i}", "h", None, None, 10 * i, 1, "d", ("ns",)) for i in range(5)], "item_ord int, id int, name string, full_name string, html_url string, description string, language string, stargazers_count int, forks_count int, updated_at string, namespace struct<path:string>")
    assert [r.full_name for r in items.projects(p, limit=2).collect()] == ["o/1", "o/0"]  # the first two to arrive, then by stars
    h = spark.createDataFrame([(0, "1", ("t", None, None, 5, 0), None, None), (1, "", ("t", "b", 9, 5, 0), None, None), (2, "2", ("t", "b" * 600, 7, None, 60), ("w",), [("x",)]), (3, "1", ("t", "b", 99, 5, 0), None, None)], "item_ord int, article_id string, article_info struct<title:string,brief_content:string,digg_count:int,view_count:int,publish_time:long>, author_user_info struct<user_name:string>, tags array<struct<tag_name:string>>")
    got = items.hot_articles(h, now()).collect()
    assert [(r.id, len(r.brief), r.author, r.digg_count, r.view_count, r.tags) for r in got] == [("2", 500, "w", 7, 0, ["x"]), ("1", 0, "掘金", 0, 5, [])]


def test_community(spark):
    c = spark.createDataFrame([(i, i % 2, "t", "d", "u", "p", i, 0, 1, ["g"], ("me",)) for i in range(4)], "item_ord int, id int, title string, description string, url string, published_at string, positive_reactions_count int, comments_count int, reading_time_minutes int, tag_list array<string>, user struct<name:string>")
    assert [(r.id, r.positive_reactions_count, r.author) for r in items.community_articles(c).collect()] == [(1, 1, "me"), (0, 0, "me")]
    s = spark.createDataFrame([(0, "a", "t", "", "http://c", 3, 0, ("w",), "2026-05-25T00:00:00Z", ["ai"]), (1, "b", "t", "http://b", "http://c", 9, 0, ("w",), "2026-05-20T00:00:00Z", ["ai"])], "item_ord int, short_id string, title string, url string, comments_url string, score int, comment_count int, submitter_user struct<username:string>, created_at string, tags array<string>")
    assert [r.url for r in items.community_stories(s, now()).collect()] == ["http://c"]


REPO = "repo string, number int, is_pull boolean, pull_request string, state string, comments int, updated_at string"


def test_repo_activity(spark):
    rows = [("r", 1, False, None, "open", 3, "2026-05-29T03:00:00Z"), ("r", 2, False, "pr", "open", 9, "2026-05-29T03:00:00Z"), ("r", 3, True, "pr", "closed", 9, "2026-05-29T03:00:00Z"), ("r", 4, True, "pr", "open", 1, "2026-05-01T00:00:00Z"), ("r", 5, False, None, "closed", 7, "2026-05-29T04:00:00Z")]
    df = spark.createDataFrame(rows, REPO)
    since = F.lit("2026-05-29 02:00:00").cast("timestamp")
    assert {r.number for r in items.recent_items(df, since).collect()} == {1, 3, 5} and {r.number for r in items.recent_items(df, since, 1).collect()} == {3, 5}
    assert [r.number for r in items.popular_items(df).orderBy(F.desc("comments")).collect()] == [5, 1, 4]
    releases = spark.createDataFrame([("v1", "2026-05-29T02:00:00Z"), ("v0", "2026-05-28T02:00:00Z")], "tag_name string, published_at string")
    assert [r.tag_name for r in items.recent_releases(releases, since).collect()] == ["v1"]


def test_the_worked_example_from_landed_product_to_pool(spark):
    p = spark.createDataFrame([(0, "Workflow AI Copilot", "http://ph", "http://x", "Enterprise AI workflow launch for customer support and revenue teams", "2026-05-30T00:30:00Z", 360, 80, ["artificial-intelligence", "enterprise", "workflow"])], "item_ord int, name string, url string, website string, tagline string, created_at string, votes_count int, comments_count int, topics array<string>")
    w = spark.createDataFrame([(0, "Multimodal launch", "http://w", "text", None, "Site", "s", "news")], "item_ord int, title string, url string, content string, lastmod string, site_name string, site string, category string")
    union = signals.normalize_signals({"official": w, "products": p})
    assert union.dtypes == spark.createDataFrame([], signals.SIGNAL).select(union.columns).dtypes
    out = {r.source: r for r in scoring.score_signals(union, now()).collect()}
    assert (out["Product Hunt"].score, out["Product Hunt"].action, out["Product Hunt"].url) == (90, "深挖", "http://x")
    p = out["Product Hunt"]
    assert p.category == R.ENTERPRISE and (p.commercial_impact, p.heat, p.freshness, p.writability) == (34, 30, 20, 6)
    assert out["Site"].tags == ["s", "news"] and out["Site"].src_ord == 6 and out["Product Hunt"].src_ord == 3
    for bad in ({}, {"nowhere": p}):
        with pytest.raises(ValueError):
            signals.normalize_signals(bad)


def test_union_leaves_out_empty_tags_where_it_should(spark):
    t = spark.createDataFrame([(0, "o/r", "u", None, "", 1, 2), (1, "o/s", "u", "d", None, 1, 2)], "item_ord int, full_name string, url string, description string, language string, today_stars int, total_stars int")
    m = spark.createDataFrame([(0, "o/m", "u", "me", "", ["", "x"], "", 3, 4)], "item_ord int, id string, url string, author string, pipeline_tag string, tags array<string>, last_modified string, likes int, downloads int")
    got = signals.normalize_signals({"trending": t, "models": m}).orderBy("src_ord", "item_ord").collect()
    assert [r.tags for r in got] == [[], [], ["x"]] and got[2].summary == " model by me" and got[0].heat_signals == [1.0, 2.0]


ITEM = "number int, title string, state string, user struct<login:string>, labels array<struct<name:string>>, created_at string, updated_at string, comments int, reactions struct<`+1`:int>, body string, html_url string"


def test_item_lines(spark):
    url = "https://github.com/o/r/issues/7"
    rows = [(7, "T", "open", ("me",), [("bug",), ("p1",)], "2026-01-02T03:00:00Z", "2026-02-03T03:00:00Z", 4, (5,), "a\nb" + "x" * 300, url), (8, "T", "closed", ("me",), [], "2026-01-02", "2026-02-03", 0, None, None, url.replace("issues/7", "pull/8")), (9, "T", "open", ("me",), None, "2026-01-02", "2026-02-03", 0, (None,), "  \tz\n", url)]
    df = spark.createDataFrame(rows, ITEM)
    a, b, c = (r.line.split("\n") for r in df.select(assembly.format_repo_item("en").alias("line")).collect())
    assert a[:3] == ["#7 [OPEN] [bug, p1] T", "  Author: me | Created: 2026-01-02 | Updated: 2026-02-03 | Comments: 4 | 👍: 5", "  URL: o/r Issue #7"]
    assert a[3] == "  Summary: a b" + "x" * 297 + "..." and b[0] == "#8 [CLOSED] T" and b[2] == "  URL: o/r PR #8" and b[3] == "  Summary: " and c[3] == "  Summary: z"
    assert df.select(assembly.format_repo_item().alias("line")).first().line.split("\n")[1].startswith("  作者: me | 创建: 2026-01-02 | 更新: ")


def test_report_order_and_feed(spark):
    order = R.report_order("pool")
    assert order == ("pool", "ai-cli", "ai-agents", "ai-web", "ai-trending", "ai-hn", "ai-ph", "ai-arxiv", "ai-hf", "ai-community", "ai-china-tech", "ai-weekly", "ai-monthly")
    names = ["ai-monthly", "ai-hn-en", "pool", "ai-cli", "other", "ai-web", "ai-hn"]
    r = spark.createDataFrame([(i, "2026-01-02", n, "<p>a  &</p>") for i, n in enumerate(names)], "doc_id int, date string, report_type string, content string")
    assert catalog.manifest(r, order).first().reports == ["pool", "ai-cli", "ai-web", "ai-hn", "ai-hn-en", "ai-monthly", "other"]
    feed = catalog.feed_items(r, order, site="https://s", labels={"pool": "The pool"}, limit=2).collect()
    assert [(f.title, f.link, f.pub_date, f.summary) for f in feed] == [("The pool 2026-01-02", "https://s/digests/2026-01-02/pool.html", "Fri, 02 Jan 2026 00:00:00 +0000", "a &amp;"), ("ai-cli 2026-01-02", "https://s/#2026-01-02/ai-cli", "Fri, 02 Jan 2026 00:00:00 +0000", "a &amp;")]
    whole = catalog.daily_concat(r).first().body
    for size, chunk in ((1, 1), (30, 2), (60, 10_000), (10_000, 3)):
        parts = catalog.digest_parts(r, part_chars=size, chunk=chunk).orderBy("part").collect()
        assert "".join(p.body for p in parts) == whole and all(whole[p.start :].startswith(p.body) for p in parts)
        assert [p.part for p in parts] == list(range(1, len(parts) + 1)) and (len(parts) == 7) == (size == 1) and (len(parts) == 1) == (size == 10_000)


def test_entity_search_and_rendering(spark):
    e = spark.createDataFrame([("open ai", "open ai"), ("ai lab", "ai lab"), ("other", "other")], "entity_id string, name string")
    got = {r.entity_id: r.score for r in retrieval.entity_search(e, "Open-AI!").collect()}
    assert set(got) == {"open ai", "ai lab"} and got["open ai"] > got["ai lab"] and retrieval.entity_search(e, " ? ").count() == 0
    hits = spark.createDataFrame([("2026-01-01", "vector", "t" * 300, 2.0), (None, None, None, 3.0)], "date string, source string, text string, score double")
    assert [r.line for r in retrieval.rendered_hits(hits, [F.desc("score")]).orderBy("n").collect()] == ["1. [/] ", "2. [2026-01-01/vector] " + "t" * 200]


def test_context_lists(spark):
    t = spark.createDataFrame([(1, "o/r", "u", None, "Go", 12, 12345, 0), (2, "o/s", "v", "d", "", 0, 5, 1200)], "item_ord int, full_name string, url string, description string, language string, today_stars int, total_stars int, forks int")
    assert contexts.source_list(t, "trending", ["item_ord"]).first().text == "- [o/r](u) [Go] ⭐12,345 (+12 today)\n- [o/s](v) ⭐5 🍴1,200\n  d"
    s = spark.createDataFrame([("T", "u", "h", 1200, 3, "me", "2026-01-02T03:04:05Z")], "title string, url string, hn_url string, points int, comments int, author string, created_at string")
    assert contexts.source_list(s, "stories", ["title"], "en").first().text == "1. **T**\n   Link: u\n   Discussion: h\n   Score: 1200 | Comments: 3 | Author: me | Time: 2026-01-02T03:04"
    assert contexts.source_list(s.limit(0), "stories", ["title"], empty="（无）").first().text == "（无）"
    sites = spark.createDataFrame([("a", "A", True, 9), ("b", "B", False, 3)], "site string, site_name string, is_first_run boolean, total int")
    items_ = spark.createDataFrame([("a", 1, "", "http://x", "news", None, ""), ("a", 0, "T", "http://y", "news", "2026-01-02T00:00", "text")], "site string, item_ord int, title string, url string, category string, lastmod string, content string")
    got = {r.site: r.text for r in contexts.official_list(sites, items_, "en").collect()}
    assert got["b"] == "## B\n\n(Incremental update, 0 new articles today, no content to analyze.)"
    assert got["a"].startswith("## A(First full crawl (sitemap total 9 URLs, showing latest 2 articles))\n\n### [T](http://y)\n- Category: news | Published/Updated: 2026-01-02\n- Excerpt: text\n\n### [http://x](http://x)\n- Category: news | Published/Updated: unknown\n- (metadata-only")
    assert set(contexts.NUMBERED) | set(contexts.BULLETS) >= {"papers", "hot_articles", "search"}
