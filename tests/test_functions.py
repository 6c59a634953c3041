from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skylark.functions import dates as D
from skylark.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "html, title, body",
    [
        ('<meta property="og:title" content="A"><title>B</title><main>x &amp; <b>y</b></main><article>z</article>', "A", "x & y"),
        ('<meta content="A2" property="og:title"><article>z<script>var a="<p>";</script> q</article>', "A2", "z q"),
        ("<title> T </title>plain <style>p{}</style> text", "T", "T plain text"),
        ("", "", ""),
    ],
)
def test_pages(spark, html, title, body):
    assert one(spark, X.page_title(F.col("h")), h=html) == title
    assert one(spark, X.page_text(F.col("h")), h=html) == body


@pytest.mark.parametrize(
    "url, category, title",
    [("https://a.b/news/gpt-5-launch", "news", "Gpt 5 Launch"), ("https://a.b/", "article", ""), ("not a url", "article", "not a url"), ("https://a.b/x?y#z", "x", "X")],
)
def test_urls(spark, url, category, title):
    assert one(spark, X.url_category(F.col("u")), u=url) == category
    assert one(spark, X.url_title(F.col("u")), u=url) == title


def test_small_text_functions(spark):
    assert one(spark, X.strip_html(F.col("h")), h="<p>a</p>b&lt;c") == "ab<c"
    assert one(spark, X.escape_xml(F.col("h")), h='<&">') == "&lt;&amp;&quot;&gt;"
    assert one(spark, X.escape_cell(F.col("h")), h="a|b\nc") == "a\\|b<br>c"
    assert one(spark, X.truncated(F.col("h"), 3), h="abcd") == "abc..."
    assert one(spark, X.neutralize_refs(F.col("h")), h="see https://github.com/a/b and @me") == "see https://github.com/​a/b and @​me"
    assert one(spark, X.extract_keywords(F.col("h")), h="GPT 模型! a gpt re-do") == ["gpt", "模型", "re-do"]
    assert one(spark, X.fenced_json(F.col("h")), h='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, X.has_any(F.col("h"), ("meta",)), h="METADATA") is True
    kinds = [one(spark, X.entity_type(F.col("h"), ("openai",), ("ai", "llm"), ("neo4j",)), h=h) for h in ("OpenAI", "langchain", "neo4j", "other")]
    assert kinds == ["company", "technology", "project", "topic_tag"]
    real = [one(spark, X.entity_type(F.col("h")), h=h) for h in ("Tencent", "百度", "langchain", "向量 embedding", "neo4j", "OpenAI Inc", "misc")]
    assert real == ["company", "company", "technology", "technology", "project", "technology", "topic_tag"]  # "ai" is within langchain and openai


def test_summaries(spark):
    heading = r"(?m)^\s*(?:#{1,6}\s*)?本周要闻"
    meta = (r"^\s*$", r"^\s*当然.*报告\s*。?\s*$")
    assert one(spark, X.sanitize_summary(F.col("h"), heading, meta), h="好的\n## 本周要闻\nx") == "## 本周要闻\nx"
    assert one(spark, X.sanitize_summary(F.col("h"), heading, meta), h="当然，以下是报告\n\nbody\n\nmore") == "body\n\nmore"


def test_dates(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    week = [one(spark, D.iso_week(ts(d)), a="") for d in ("2026-03-09", "2026-01-05", "2025-12-29", "2026-01-12")]
    assert week == ["2026-W11", "2026-W02", "2026-W01", "2026-W03"]
    assert one(spark, D.business_date(ts("2026-01-01 17:00:00")), a="") == "2026-01-02"
    assert one(spark, D.rfc822(ts("2026-03-09 01:02:03")), a="") == "Mon, 09 Mar 2026 01:02:03 +0000"
    parse = lambda s: one(spark, D.parse_time(F.col("t")), t=s)
    assert parse("Mon, 09 Mar 2026 01:02:03 +0000") == dt.datetime(2026, 3, 9, 1, 2, 3) == parse("2026-03-09T01:02:03Z")
    assert parse("nonsense") is None
