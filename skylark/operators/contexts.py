"""Lists of a source's best rows as one text each, as they are given to a writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assembly import capped_list

# The words of the lists, and what stands for an empty one.
WORDS = {
    "en": {"link": "Link", "talk": "Discussion", "score": "Score", "comments": "Comments", "author": "Author", "authors": "Authors", "time": "Time", "site": "Website", "votes": "Votes", "topics": "Topics", "categories": "Categories", "published": "Published", "abstract": "Abstract", "task": "Pipeline", "likes": "Likes", "downloads": "Downloads", "tags": "Tags", "reactions": "Reactions", "reading": "Reading", "minutes": "min"},
    "zh": {"link": "链接", "talk": "讨论", "score": "分数", "comments": "评论", "author": "作者", "authors": "作者", "time": "时间", "site": "官网", "votes": "投票", "topics": "话题", "categories": "分类", "published": "发布", "abstract": "摘要", "task": "任务", "likes": "点赞", "downloads": "下载", "tags": "标签", "reactions": "点赞", "reading": "阅读", "minutes": "分钟"},
}
NUMBERED = ("stories", "products", "papers", "models", "community_articles", "community_stories", "news", "topic_articles", "projects", "project_news", "hot_articles")
BULLETS = ("trending", "search")


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def _line(*pieces: Column | str) -> Column:
    """Pieces end to end: columns, and texts in which a word in angle brackets is a column's name."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.col(p[1:-1]).cast("string") if p.startswith("<") else F.lit(p) for p in pieces])


def entry(source: str, lang: str = "zh") -> Column:
    """The text of one row of a source, without its number."""
    w = WORDS[lang]
    joined = lambda c, n=None: F.array_join(F.col(c) if n is None else F.slice(c, 1, n), ", ")
    said = lambda c, n: F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, "...").otherwise(""))
    head, link = _line("**", "<title>", "**"), _line(f"   {w['link']}: ", "<url>")
    if source in BULLETS:
        language = F.when(F.length("language") > 0, _line(" [", "<language>", "]")).otherwise("")
        about = F.when(F.length("description") > 0, _line("\n  ", "<description>")).otherwise("")
        if source == "search":
            return F.concat(_line("[", "<full_name>", "](", "<url>", ")"), language, F.lit(" ⭐"), thousands(F.col("stargazers_count")), _line(" [topic:", "<search_query>", "]"), about)
        today = F.when(F.col("today_stars") > 0, _line(" (+", "<today_stars>", " today)")).otherwise("")
        forks = F.when(F.col("forks") > 0, F.concat(F.lit(" 🍴"), thousands(F.col("forks")))).otherwise("")
        return F.concat(_line("[", "<full_name>", "](", "<url>", ")"), language, F.lit(" ⭐"), thousands(F.col("total_stars")), today, forks, about)
    lines = {
        "stories": lambda: [head, link, _line(f"   {w['talk']}: ", "<hn_url>"), _line(f"   {w['score']}: ", "<points>", f" | {w['comments']}: ", "<comments>", f" | {w['author']}: ", "<author>", f" | {w['time']}: ", F.substring("created_at", 1, 16))],
        "products": lambda: [_line("**", "<name>", "** — ", "<tagline>"), _line("   Product Hunt: ", "<url>"), _line(f"   {w['site']}: ", "<website>"), _line(f"   {w['votes']}: ", "<votes_count>", f" | {w['comments']}: ", "<comments_count>", f" | {w['topics']}: ", joined("topics"))],
        "papers": lambda: [head, link, _line(f"   {w['authors']}: ", capped_list(F.col("authors"), 3), f" | {w['categories']}: ", joined("categories", 3)), _line(f"   {w['published']}: ", F.substring("published", 1, 10)), _line(f"   {w['abstract']}: ", said("summary", 300))],
        "models": lambda: [_line("**", "<id>", "**"), link, _line(f"   {w['author']}: ", "<author>", f" | {w['task']}: ", F.coalesce(F.nullif("pipeline_tag", F.lit("")), F.lit("N/A"))), _line(f"   {w['likes']}: ", thousands(F.col("likes")), f" | {w['downloads']}: ", thousands(F.col("downloads"))), _line(f"   {w['tags']}: ", joined("tags", 5))],
        "community_articles": lambda: [head, link, _line(f"   {w['author']}: ", "<author>", f" | {w['reactions']}: ", "<positive_reactions_count>", f" | {w['comments']}: ", "<comments_count>", f" | {w['reading']}: ", "<reading_time_minutes>", f" {w['minutes']}"), _line(f"   {w['tags']}: ", joined("tags")), _line("   ", "<description>")],
        "community_stories": lambda: [head, link, _line(f"   {w['talk']}: ", "<comments_url>"), _line(f"   {w['score']}: ", "<score>", f" | {w['comments']}: ", "<comment_count>", f" | {w['author']}: ", "<author>", f" | {w['tags']}: ", joined("tags"))],
        "news": lambda: [head, link, _line(f"   {w['author']}: ", "<author>", f" | {w['published']}: ", F.substring("published_at", 1, 16)), _line("   ", "<summary>")],
        "topic_articles": lambda: [head, link, _line(f"   {w['author']}: ", "<author>", f" | {w['topics']}: ", joined("topics")), _line("   ", "<summary>")],
        "projects": lambda: [_line("**", "<full_name>", "** [", "<language>", "]"), link, F.concat(F.lit("   ⭐"), thousands(F.col("stars")), F.lit(" 🍴"), thousands(F.col("forks"))), _line("   ", "<description>")],
        "hot_articles": lambda: [head, link, _line(f"   {w['author']}: ", "<author>", " | 👍", "<digg_count>", " 👀", "<view_count>", f" | {w['tags']}: ", joined("tags")), _line("   ", "<brief>")],
    }
    lines["project_news"] = lines["news"]
    return F.concat_ws("\n", *lines[source]())


def source_list(rows: DataFrame, source: str, order: Sequence[Column | str], lang: str = "zh", empty: str = "") -> DataFrame:
    """(n, text), one row: the entries in order, numbered (trending and search: with bullets), or ``empty``. The rows are
    a source's best, some dozens, so they are one text."""
    rank = F.row_number().over(Window.orderBy(*order))
    mark = F.lit("- ") if source in BULLETS else F.concat(F.col("_n").cast("string"), F.lit(". "))
    texts = rows.withColumn("_n", rank).select("_n", F.concat(mark, entry(source, lang)).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "t"))), lambda x: x["t"]), "\n" if source in BULLETS else "\n\n")
    return texts.agg(F.count("*").alias("n"), joined.alias("text")).select("n", F.when(F.col("n") == 0, F.lit(empty)).otherwise(F.col("text")).alias("text"))


def official_list(sites: DataFrame, items: DataFrame, lang: str = "zh") -> DataFrame:
    """(site, text): each site's new pages under its heading, or a note that there are none. sites: (site, site_name,
    is_first_run, total); items: (site, item_ord, title, url, category, lastmod, content)."""
    en = lang == "en"
    category, date, unknown, excerpt = ("Category", "Published/Updated", "unknown", "Excerpt") if en else ("分类", "发布/更新", "未知", "内容节选")
    bare = "(metadata-only: title derived from URL slug, may be inaccurate; no article text available)" if en else "（仅元数据：标题由 URL 路径推断，可能不准确；无法获取正文内容）"
    given = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")))
    said = F.when(F.length("content") > 0, _line(f"- {excerpt}: ", "<content>")).otherwise(F.lit(f"- {bare}"))
    text = F.concat_ws("\n", _line("### [", F.coalesce(given("title"), F.col("url")), "](", "<url>", ")"), _line(f"- {category}: ", "<category>", f" | {date}: ", F.coalesce(F.substring(given("lastmod"), 1, 10), F.lit(unknown))), said)
    lists = items.select("site", F.struct("item_ord", text.alias("t")).alias("x")).groupBy("site").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("list"))
    rows = sites.join(lists, "site", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = _line("First full crawl (sitemap total ", "<total>", " URLs, showing latest ", "<n>", " articles)") if en else _line("首次全量抓取（sitemap 共 ", "<total>", " 条 URL，以下为最新 ", "<n>", " 篇正文内容）")
    more = _line("Incremental update, ", "<n>", " new articles today") if en else _line("今日增量更新，共 ", "<n>", " 篇新内容")
    mode = F.when(F.col("is_first_run"), full).otherwise(more)
    (left, right), none = ("()" if en else "（）"), ", no content to analyze." if en else "，暂无可供分析的内容。"
    head = _line("## ", "<site_name>")
    return rows.select("site", F.when(F.col("n") == 0, F.concat(head, F.lit(f"\n\n{left}"), mode, F.lit(f"{none}{right}"))).otherwise(F.concat(head, F.lit(left), mode, F.lit(f"{right}\n\n"), "list")).alias("text"))
