"""Twelve typed inputs as one signal schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNAL = "title string, url string, source string, source_type string, summary string, published_at string, heat_signals array<double>, tags array<string>, src_ord int, item_ord long"


def _signal(title: str, source: Column | str, kind: str, summary: Column | str, published: str | None = None, heat: tuple[str, ...] = (), tags: Column | None = None, url: Column | str = "url") -> Callable[[DataFrame], DataFrame]:
    """A projection to the signal schema; texts are column names, fixed labels are literal columns."""

    def project(rows: DataFrame) -> DataFrame:
        at = F.col(published) if published else F.lit(None).cast("string")
        hot = F.array(*[F.col(h).cast("double") for h in heat]).cast("array<double>")
        found = F.array().cast("array<string>") if tags is None else F.coalesce(tags, F.array().cast("array<string>"))
        return rows.select(F.col(title).alias("title"), (F.col(url) if isinstance(url, str) else url).alias("url"), source.alias("source"), F.lit(kind).alias("source_type"), (F.col(summary) if isinstance(summary, str) else summary).alias("summary"), at.alias("published_at"), hot.alias("heat_signals"), found.alias("tags"), F.col("item_ord").cast("long").alias("item_ord"))

    return project


def _given(*tags: Column) -> Column:
    """The tags that are there."""
    return F.filter(F.array(*tags), lambda t: t != "")


# The inputs in the order in which they are listed, and their labels.
INPUTS = ("trending", "search", "stories", "products", "papers", "models", "official", "news", "topic_articles", "projects", "project_news", "hot_articles")


def _projections() -> dict[str, Callable[[DataFrame], DataFrame]]:
    none = F.lit("")
    return {
        "trending": _signal("full_name", F.lit("GitHub Trending"), "github", "description", None, ("today_stars", "total_stars"), _given(F.col("language"))),
        "search": _signal("full_name", F.concat(F.lit("GitHub Search:"), "search_query"), "github", F.coalesce("description", none), "pushed_at", ("stargazers_count",), _given(F.coalesce("language", none), F.col("search_query"))),
        "stories": _signal("title", F.lit("Hacker News"), "community", F.concat(F.lit("HN discussion by "), "author"), "created_at", ("points", "comments"), F.array(F.lit("community"), F.lit("discussion"))),
        "products": _signal("name", F.lit("Product Hunt"), "product", "tagline", "created_at", ("votes_count", "comments_count"), F.col("topics"), F.coalesce(F.nullif(F.col("website"), none), "url")),
        "papers": _signal("title", F.lit("ArXiv"), "research", "summary", "published", (), F.col("categories")),
        "models": _signal("id", F.lit("Hugging Face"), "model", F.concat("pipeline_tag", F.lit(" model by "), "author"), "last_modified", ("likes", "downloads"), F.filter(F.concat(F.array("pipeline_tag"), "tags"), lambda t: t != "")),
        "official": _signal("title", F.col("site_name"), "official", "content", "lastmod", (), F.array("site", "category")),
        "news": _signal("title", F.lit("36kr"), "community", "summary", "published_at", (), F.array(F.lit("36kr"), F.lit("中国AI"))),
        "topic_articles": _signal("title", F.lit("InfoQ 中国"), "community", "summary", "publish_time", (), F.concat(F.array(F.lit("infoq-cn")), "topics")),
        "projects": _signal("full_name", F.lit("Gitee"), "github", "description", "updated_at", ("stars", "forks"), _given(F.lit("gitee"), F.col("language"))),
        "project_news": _signal("title", F.lit("开源中国"), "community", "summary", "published_at", (), F.array(F.lit("oschina"), F.lit("中国AI"))),
        "hot_articles": _signal("title", F.lit("掘金"), "community", "brief", "publish_time", ("digg_count", "view_count"), F.concat(F.array(F.lit("juejin")), "tags")),
    }


def normalize_signals(inputs: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each row of the inputs (any of ``INPUTS``, typed as the normalisers give them, with item_ord), in a
    fixed order: src_ord numbers the inputs, so (src_ord, item_ord) breaks ties as collection does."""
    if not inputs or not set(inputs) <= set(INPUTS):
        raise ValueError(f"inputs must be some of {', '.join(INPUTS)}")
    project = _projections()
    parts = [project[name](inputs[name]).withColumn("src_ord", F.lit(i)) for i, name in enumerate(INPUTS) if name in inputs]
    return reduce(DataFrame.unionByName, parts)
