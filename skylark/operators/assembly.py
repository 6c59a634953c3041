"""Report, digest and message texts assembled as data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packing import packed_blocks
from ..functions.text import escape_cell, escape_xml


def by_score() -> list[Column]:
    """Best score first, ties in order of collection."""
    return [F.desc("score"), F.col("src_ord"), F.col("item_ord")]


def section_tables(pool: DataFrame, actions: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """(action, body): markdown table rows of each section in rank order, or a placeholder."""
    w = Window.partitionBy("action").orderBy(*(order or by_score()))
    link = F.concat(F.lit("["), escape_cell(F.col("title")), F.lit("]("), "url", F.lit(")"))
    cells = [F.col("score").cast("string"), F.col("action"), link, F.col("category"), escape_cell(F.col("recommended_topic")), F.col("reason"), F.array_join("evidence", "<br>")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = pool.select("action", F.row_number().over(w).alias("n"), line.alias("line"))
    bodies = rows.groupBy("action").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    wanted = pool.sparkSession.createDataFrame([(a,) for a in actions], "action string")
    return wanted.join(bodies, "action", "left").select("action", F.coalesce("body", F.lit("_暂无条目。_")).alias("body"))


# The words of an item's lines.
ITEM_WORDS = {
    "en": ("Author", "Created", "Updated", "Comments", "URL", "Summary"),
    "zh": ("作者", "创建", "更新", "评论", "链接", "摘要"),
}


def format_repo_item(lang: str = "zh", body: int = 300) -> Column:
    """Four lines: number, state, labels and title; author, dates, comments and thumbs; the repository and kind, not the
    address (which would make a link); the body's first characters. Columns as landed: labels array<struct<name>>, user
    struct<login>, reactions struct<+1>, created_at and updated_at as text or time, html_url, body."""
    author, created, updated, comments, link, summary = ITEM_WORDS[lang]
    number = F.col("number").cast("string")
    names = F.array_join(F.transform(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), ", ")
    day = lambda c: F.substring(F.col(c).cast("string"), 1, 10)
    thumbs = F.coalesce(F.col("reactions")["+1"], F.lit(0)).cast("string")
    slug = F.regexp_replace(F.regexp_replace("html_url", r"^https://github\.com/", ""), r"/(issues|pull)/\d+$", "")
    kind = F.when(F.contains("html_url", F.lit("/pull/")), "PR").otherwise("Issue")
    text = F.coalesce("body", F.lit(""))
    flat = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("#"), number, F.lit(" ["), F.upper("state"), F.lit("]"), F.when(names != "", F.concat(F.lit(" ["), names, F.lit("]"))).otherwise(""), F.lit(" "), "title"),
        F.concat(F.lit(f"  {author}: "), F.col("user")["login"], F.lit(f" | {created}: "), day("created_at"), F.lit(f" | {updated}: "), day("updated_at"), F.lit(f" | {comments}: "), F.col("comments").cast("string"), F.lit(" | 👍: "), thumbs),
        F.concat(F.lit(f"  {link}: "), slug, F.lit(" "), kind, F.lit(" #"), number),
        F.concat(F.lit(f"  {summary}: "), F.substring(flat, 1, body), F.when(F.length(text) > body, "...").otherwise("")),
    )


def sample_note(total: Column, shown: Column | int) -> Column:
    shown = F.lit(shown) if isinstance(shown, int) else shown
    more = F.concat(F.lit("(Total: "), total.cast("string"), F.lit(" items; showing top "), shown.cast("string"), F.lit(" by comment count)"))
    return F.when(total > shown, more).otherwise(F.concat(F.lit("(Total: "), total.cast("string"), F.lit(" items)")))


def repo_context(items: DataFrame, repos: DataFrame, issues: int = 30, pulls: int = 20, lang: str = "en") -> DataFrame:
    """(repo, context): the most commented issues and pull requests of each repository, or "No activity". ``repos`` is a
    configured list. What is ranked is only what decides the rank, cut to a fixed number of each kind before it moves;
    bodies are read for the chosen ones alone."""
    w = Window.partitionBy("repo", "is_pr").orderBy(F.desc("comments"), "number")
    ranked = lambda rows: rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max(issues, pulls))
    place = ["repo", "is_pr", "comments", "number"]
    chosen = ranked(items.select(place)).join(repos, "repo", "left_semi").select([F.col(c).alias(f"_{c}") for c in place])  # at most that many for each kind of a listed repository
    same = F.lit(True)
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    top = ranked(items.join(F.broadcast(chosen), same, "left_semi")).filter(F.col("n") <= F.when(F.col("is_pr"), pulls).otherwise(issues))
    counts = items.groupBy("repo").agg(F.count_if(~F.col("is_pr")).alias("n_issues"), F.count_if(F.col("is_pr")).alias("n_pulls"))
    lines = top.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("is_pr", "n", format_repo_item(lang).alias("line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    context = F.concat(F.lit("Issues "), sample_note(F.col("n_issues"), issues), F.lit(", PRs "), sample_note(F.col("n_pulls"), pulls), F.lit("\n"), body)
    return repos.join(counts.join(lines, "repo"), "repo", "left").select("repo", F.coalesce(context, F.lit("No activity")).alias("context"))


def comparison_context(contexts: DataFrame) -> DataFrame:
    """One text with a section for each repository, in order of name: repositories are those of a configured list."""
    section = F.concat(F.lit("## "), "repo", F.lit("\n"), "context")
    return contexts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repo", section.alias("s")))), lambda r: r["s"]), "\n\n").alias("context"))


def capped_list(items: Column, limit: int, more: str = " et al.", sep: str = ", ") -> Column:
    return F.concat(F.array_join(F.slice(items, 1, limit), sep), F.when(F.size(items) > limit, more).otherwise(""))


def pack_blocks(df: DataFrame, key: str, text: str = "text", limit: int = 3400) -> DataFrame:
    """(key, pos, block): texts cut at section markers, then at lines, into blocks of about ``limit`` characters."""

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: packed_blocks(t or "", limit))

    return df.select(key, F.posexplode(cut(text)).alias("pos", "block"))


def pool_message(pool: DataFrame, caps: dict[str, int], order: Sequence[Column | str] | None = None) -> DataFrame:
    """(action, rank, line) of the message sections; the recommended topic falls back to one from the angle."""
    from .ranking import top_per_group

    angle = F.regexp_replace(F.regexp_replace("angle", "^适合从", ""), "角度切入$", "")
    topic = F.coalesce(F.nullif(F.col("recommended_topic"), F.lit("")), F.concat("title", F.lit(" 为什么值得关注？（"), F.coalesce(F.nullif(angle, F.lit("")), "category"), F.lit("）")))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), escape_xml(F.col("title")), F.lit("\n"), F.col("score").cast("string"), F.lit(" / "), "action", F.lit("\n"), escape_xml(topic), F.lit("\n"), F.array_join(F.slice("evidence", 1, 3), "；"))
    return top_per_group(pool, "action", caps, order or by_score()).select("action", "rank", line.alias("line"))


def report_links(reports: DataFrame, highlights: DataFrame | None = None) -> DataFrame:
    """(date, report, has_en, is_rollup, highlights): base reports with their English twin, dailies first."""
    r = reports.select("date", F.col("report_type").alias("report")).distinct()
    base = r.filter(~F.endswith("report", F.lit("-en")))
    twins = r.filter(F.endswith("report", F.lit("-en"))).select("date", F.regexp_replace("report", "-en$", "").alias("report"), F.lit(True).alias("has_en"))
    out = base.join(twins, ["date", "report"], "left").withColumn("has_en", F.coalesce("has_en", F.lit(False)))
    out = out.withColumn("is_rollup", F.contains("report", F.lit("weekly")) | F.contains("report", F.lit("monthly")))
    if highlights is None:
        return out
    per = highlights.groupBy("date", "report").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda h: F.concat(F.lit("  ◦ "), escape_xml(h["text"]))), "\n").alias("highlights"))
    return out.join(per, ["date", "report"], "left")
