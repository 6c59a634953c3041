"""Landed API rows of each source to typed rows: keep-first dedup, keyword filters, windows, cuts and fallbacks.

Inputs are the payload's items, one row each, with ``item_ord`` (order of arrival). ``limit`` None keeps every row; a
``now`` of None skips the time window and leaves missing times null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.dates import iso_time, parse_time
from ..functions.text import has_any
from ..operators.ranking import early_cut, keep_first, top_per_group
from . import landed

def text_or(column: Column | str, *others: Column | str) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (column, *others)]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def about(rows: DataFrame, keywords: Sequence[str], *columns: Column | str) -> DataFrame:
    """Rows whose columns, joined by spaces, contain one of the keywords in either case."""
    return rows.filter(has_any(F.concat_ws(" ", *columns), keywords))


def best(rows: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    return rows if limit is None else rows.orderBy(*order, "item_ord").limit(limit)


def arrived(rows: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows to arrive, then in order."""
    return rows if limit is None else early_cut(rows, limit, ["item_ord"], [*order, "item_ord"])


def since(rows: DataFrame, column: str, now: Column | None, hours: int) -> DataFrame:
    """Rows of the last ``hours``; a time that cannot be read is not among them."""
    return rows if now is None else rows.filter(parse_time(F.col(column)) > now - F.make_interval(hours=F.lit(hours)))


def epoch_time(seconds: Column, now: Column | None) -> Column:
    """ISO time of epoch seconds; zero or missing is now."""
    ts = F.when(seconds != 0, F.timestamp_seconds(seconds))
    return iso_time(ts if now is None else F.coalesce(ts, now))


def trending_repos(pages: DataFrame, site: str = "https://github.com/") -> DataFrame:
    """Blocks of a trending page (column value) as repositories with their address."""
    return landed.trending_blocks(pages).withColumn("url", F.concat(F.lit(site), "full_name"))


def search_repos(items: DataFrame) -> DataFrame:
    """Search hits of several queries: a repository counts for the first that found it."""
    first = keep_first(items, ["full_name"], ["item_ord"])
    return first.select("item_ord", "full_name", "description", "language", "stargazers_count", "pushed_at", F.col("html_url").alias("url"), "search_query")


def stories(hits: DataFrame, now: Column | None = None, limit: int | None = 30, page: str = "https://news.ycombinator.com/item?id=") -> DataFrame:
    """Story hits of several queries in the last day, best by points; a story without an address has its discussion's."""
    rows = keep_first(since(hits, "created_at", now, 24), ["id"], ["item_ord"])
    talk = F.concat(F.lit(page), F.col("id").cast("string"))
    points, comments = F.coalesce("points", F.lit(0)), F.coalesce("num_comments", F.lit(0))
    out = rows.select("item_ord", "id", "title", F.coalesce("url", talk).alias("url"), talk.alias("hn_url"), points.alias("points"), comments.alias("comments"), "author", "created_at")
    return best(out, limit, F.desc("points"))


def products(edges: DataFrame, now: Column | None = None, slugs: Sequence[str] = R.AI_TOPIC_SLUGS, limit: int | None = 30) -> DataFrame:
    """Product edges (column node) posted between one and two days ago that have one of the topics, best by votes."""
    n = F.col("node")
    rows = edges.filter(F.arrays_overlap(F.transform(n["topics"]["edges"], lambda e: e["node"]["slug"]), F.array(*[F.lit(s) for s in slugs])))
    if now is not None:
        rows = since(rows.withColumn("_at", n["created_at"]), "_at", now, 48).filter(parse_time(F.col("_at")) <= now - F.expr("INTERVAL 24 HOURS"))
    out = rows.select(
        "item_ord", n["id"].alias("id"), n["name"].alias("name"), n["tagline"].alias("tagline"), n["url"].alias("url"), text_or(n["website"], n["url"]).alias("website"),
        n["votes_count"].alias("votes_count"), n["comments_count"].alias("comments_count"), n["created_at"].alias("created_at"), F.transform(n["topics"]["edges"], lambda e: e["node"]["name"]).alias("topics"),
    )
    return best(out, limit, F.desc("votes_count"))


def papers(feeds: DataFrame, now: Column | None = None, limit: int | None = 50) -> DataFrame:
    """Entries of several category feeds (columns item_ord, value): each id once, of the last 48 hours, newest first."""
    rows = keep_first(landed.atom_entries(feeds), ["id"], ["item_ord"])
    return best(since(rows, "published", now, 48), limit, F.desc(parse_time(F.col("published"))))


def models(rows: DataFrame, site: str = "https://huggingface.co/") -> DataFrame:
    """Model rows with defaults: the author falls back to the id before its slash, then to unknown."""
    author = F.coalesce("author", F.split_part("id", F.lit("/"), F.lit(1)), F.lit("unknown"))
    return rows.select(
        "item_ord", "id", author.alias("author"), "likes", "downloads", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("pipeline_tag", F.lit("")).alias("pipeline_tag"),
        F.coalesce("last_modified", F.lit("")).alias("last_modified"), F.concat(F.lit(site), "id").alias("url"),
    )


def news(feeds: DataFrame, now: Column | None = None, keywords: Sequence[str] = R.NEWS_KEYWORDS, author: tuple[str, ...] = ("dc:creator", "author"), house: str = "36kr", limit: int | None = 30) -> DataFrame:
    """News items of a feed about the keywords, the first to arrive; ``house`` stands for a missing author."""
    rows = about(landed.rss_items(feeds, author=author), keywords, "title", "description")
    out = rows.select("item_ord", F.col("guid").alias("id"), "title", F.col("link").alias("url"), "summary", _or_now("published_at", now).alias("published_at"), text_or("author", F.lit(house)).alias("author"))
    return arrived(out, limit)


def project_news(feeds: DataFrame, now: Column | None = None, limit: int | None = 30) -> DataFrame:
    """The second news feed: its own keywords, authors the other way round."""
    return news(feeds, now, R.PROJECT_NEWS_KEYWORDS, ("author", "dc:creator"), "OSChina", limit)


def _or_now(column: str, now: Column | None) -> Column:
    return F.col(column) if now is None else F.coalesce(F.nullif(F.col(column), F.lit("")), iso_time(now))


def topic_articles(items: DataFrame, now: Column | None = None, keywords: Sequence[str] = R.ARTICLE_KEYWORDS, limit: int | None = 30, site: str = "https://www.infoq.cn/article/") -> DataFrame:
    """Articles about the keywords in title, description or topics, each id once, the first to arrive."""
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    rows = about(items, keywords, F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.array_join(topics, " "))
    rows = keep_first(rows.withColumn("_id", F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("0")), "uuid")), ["_id"], ["item_ord"])
    out = rows.select(
        "item_ord", F.col("_id").alias("id"), "title", text_or("url", F.concat(F.lit(site), "uuid")).alias("url"), F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("summary"),
        text_or(F.col("author")["nickname"], F.col("author")["name"], F.lit("InfoQ")).alias("author"), epoch_time(F.col("publish_time"), now).alias("publish_time"), topics.alias("topics"),
    )
    return arrived(out, limit)


def projects(items: DataFrame, keywords: Sequence[str] = R.PROJECT_KEYWORDS, limit: int | None = 30) -> DataFrame:
    """Projects about the keywords in name or description, each id once: the first to arrive, then by stars."""
    description = F.coalesce("description", F.lit(""))
    rows = keep_first(about(items, keywords, "name", description), ["id"], ["item_ord"])
    out = rows.select(
        "item_ord", "id", "name", "full_name", F.col("html_url").alias("url"), description.alias("description"), F.coalesce("language", F.lit("")).alias("language"), F.col("stargazers_count").alias("stars"),
        F.col("forks_count").alias("forks"), "updated_at", F.col("namespace")["path"].alias("namespace"),
    )
    return arrived(out, limit, F.desc("stars"))


def hot_articles(items: DataFrame, now: Column | None = None, limit: int | None = 30, site: str = "https://juejin.cn/post/") -> DataFrame:
    """Nested article rows, each id once: the first to arrive, then by diggs."""
    info = F.col("article_info")
    rows = keep_first(items.filter(F.col("article_id") != ""), ["article_id"], ["item_ord"])
    out = rows.select(
        "item_ord", F.col("article_id").alias("id"), info["title"].alias("title"), F.concat(F.lit(site), "article_id").alias("url"), F.substring(F.coalesce(info["brief_content"], F.lit("")), 1, 500).alias("brief"),
        F.coalesce(F.col("author_user_info")["user_name"], F.lit("掘金")).alias("author"), F.coalesce(info["digg_count"], F.lit(0)).alias("digg_count"), F.coalesce(info["view_count"], F.lit(0)).alias("view_count"),
        F.transform(F.coalesce("tags", F.array().cast("array<struct<tag_name:string>>")), lambda t: t["tag_name"]).alias("tags"), epoch_time(info["publish_time"], now).alias("publish_time"),
    )
    return arrived(out, limit, F.desc("digg_count"))


def community_articles(items: DataFrame, limit: int | None = 30) -> DataFrame:
    """Articles of several tag queries, each id once, best by reactions."""
    rows = keep_first(items, ["id"], ["item_ord"])
    out = rows.select("item_ord", "id", "title", "description", "url", "published_at", "positive_reactions_count", "comments_count", "reading_time_minutes", F.col("tag_list").alias("tags"), F.col("user")["name"].alias("author"))
    return best(out, limit, F.desc("positive_reactions_count"))


def community_stories(items: DataFrame, now: Column | None = None, limit: int | None = 20) -> DataFrame:
    """Stories of several tag pages, each id once, of the last seven days, best by score."""
    rows = since(keep_first(items, ["short_id"], ["item_ord"]), "created_at", now, 168)
    out = rows.select("item_ord", "title", text_or("url", "comments_url").alias("url"), "comments_url", "score", "comment_count", F.col("submitter_user")["username"].alias("author"), F.col("created_at").alias("published_at"), "tags")
    return best(out, limit, F.desc("score"))


def recent_items(items: DataFrame, since: Column, per_repo: int | None = 500) -> DataFrame:
    """Issues and pull requests updated since a time, the newest ``per_repo`` of each repository and kind; issue rows
    that are pull requests (pull_request is set) are left to the pull requests."""
    rows = items.filter((F.col("is_pull") | F.col("pull_request").isNull()) & (parse_time(F.col("updated_at")) >= since))
    if per_repo is None:
        return rows
    rows = rows.withColumn("_g", F.struct("repo", "is_pull"))
    return top_per_group(rows, "_g", per_repo, [F.desc(parse_time(F.col("updated_at"))), "number"], "_rank").drop("_g", "_rank")


def recent_releases(releases: DataFrame, since: Column) -> DataFrame:
    return releases.filter(parse_time(F.col("published_at")) >= since)


def popular_items(items: DataFrame, limit: int | None = 50) -> DataFrame:
    """Open pull requests and issues of any state, most commented first, without a window."""
    rows = items.filter(F.when(F.col("is_pull"), F.col("state") == "open").otherwise(F.col("pull_request").isNull()))
    if limit is None:
        return rows
    return top_per_group(rows.withColumn("_g", F.struct("repo", "is_pull")), "_g", limit, [F.desc("comments"), "number"], "_rank").drop("_g", "_rank")
