"""Manifest, feed, search index, listings and roll-ups over dated reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import rfc822
from ..functions.text import escape_xml, squeeze, truncated


def ordinal(name: Column, order: Sequence[str]) -> Column:
    """Place of a base report name in the fixed order (others after it, by name), base before -en."""
    base = F.regexp_replace(name, "-en$", "")
    out = F.lit(len(order))
    for i, n in enumerate(order):
        out = F.when(base == n, i).otherwise(out)
    return out


def manifest(reports: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per date the reports that exist, in order; newest date first."""
    r = reports.select("date", "report_type").distinct()
    listed = r.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(ordinal(F.col("report_type"), order).alias("o"), F.col("report_type").alias("r")))).alias("x"))
    return listed.select("date", F.transform("x", lambda s: s["r"]).alias("reports")).orderBy(F.desc("date"))


def report_link(order: Sequence[str], site: str = "") -> Column:
    """The pool's own report, first in the order, has a page of its own; the others are places on the front page."""
    own = F.concat(F.lit(f"{site}/digests/"), "date", F.lit("/"), "report_type", F.lit(".html"))
    return F.when(F.col("report_type") == order[0], own).otherwise(F.concat(F.lit(f"{site}/#"), "date", F.lit("/"), "report_type"))


def feed_items(reports: DataFrame, order: Sequence[str], limit: int = 30, site: str = "", labels: dict[str, str] | None = None) -> DataFrame:
    """The newest (date, report) pairs: title (the report's label and date), link (also the guid), RFC-822 date of the
    day and a plain-text summary."""
    text = squeeze(F.regexp_replace("content", r"<[^>]+>", ""))
    label = F.col("report_type")
    for name, shown in (labels or {}).items():
        label = F.when(F.col("report_type") == name, shown).otherwise(label)
    first = reports.withColumn("_o", ordinal(F.col("report_type"), order)).orderBy(F.desc("date"), "_o", "report_type", "doc_id").limit(limit)
    return first.select(
        "date", "report_type", "doc_id", escape_xml(F.concat_ws(" ", label, "date")).alias("title"), escape_xml(report_link(order, site)).alias("link"),
        rfc822(F.to_timestamp("date", "yyyy-MM-dd")).alias("pub_date"), escape_xml(truncated(text, 500)).alias("summary"),
    )


def latest_dates(df: DataFrame, n: int) -> list[str]:
    """The newest n dates: a small distinct, resolved first so that partitions can be pruned."""
    return [r["date"] for r in df.select("date").distinct().orderBy(F.desc("date")).limit(n).collect()]


def list_reports(reports: DataFrame, n: int = 7) -> DataFrame:
    """Reports of the newest n dates (30 at most)."""
    dates = latest_dates(reports, max(1, min(30, n)))
    return reports.filter(F.col("date").isin(dates)).groupBy("date", "report_type").agg(F.count("*").alias("n"))


def get_report(reports: DataFrame, date: str, report_type: str) -> DataFrame:
    import re

    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        raise ValueError("date must be YYYY-MM-DD")
    return reports.filter((F.col("date") == date) & (F.col("report_type") == report_type))


def latest_report(reports: DataFrame) -> DataFrame:
    """The newest report of each type."""
    return reports.groupBy("report_type").agg(F.max_by("doc_id", F.struct("date", "doc_id")).alias("doc_id"), F.max("date").alias("date"))


def selected_reports(reports: DataFrame) -> DataFrame:
    """Base reports, daily before weekly and monthly."""
    name = F.col("report_type")
    rollup = F.contains(name, F.lit("weekly")) | F.contains(name, F.lit("monthly"))
    return reports.filter(~F.endswith(name, F.lit("-en"))).withColumn("is_rollup", rollup)


def daily_concat(reports: DataFrame, limit: int = 2000, separator: str = "\n\n---\n\n") -> DataFrame:
    """Per date the texts in order of report, each cut to ``limit`` characters. One row holds a day, so a day's reports
    must be few (some thousands): it is the size of one digest. ``digest_parts`` has the same in parts."""
    part = F.struct("report_type", "doc_id", F.concat(F.lit("## "), "report_type", F.lit("\n"), F.substring("content", 1, limit)).alias("t"))
    return reports.groupBy("date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), separator).alias("body"))


def digest_parts(reports: DataFrame, limit: int = 2000, part_chars: int = 100_000, separator: str = "\n\n---\n\n", chunk: int = 10_000) -> DataFrame:
    """(date, part, start, body): the text that ``daily_concat`` gives for a day, cut between reports into parts of about
    ``part_chars`` characters; ``start`` is a part's place in it, and the parts end to end are the whole. For days of any
    size: places are summed within ranges of ``chunk`` ids, then over the ranges, then added up."""
    text = F.concat(F.lit("## "), "report_type", F.lit("\n"), F.substring("content", 1, limit))
    rows = reports.select("date", "report_type", F.floor(F.col("doc_id") / chunk).alias("_range"), "doc_id", F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.withColumn("_size", (F.length("_text") + len(separator)).cast("long"))
    group = ["date", "report_type", "_range"]
    before = Window.unboundedPreceding, -1
    upto = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(*before)), F.lit(0))
    ranges = rows.groupBy(group).agg(F.sum("_size").alias("_sum"))  # a row for each range
    ranges = ranges.select(*group, upto(Window.partitionBy("date").orderBy("report_type", "_range"), "_sum").alias("_first"))
    placed = rows.withColumn("_in", upto(Window.partitionBy(group).orderBy("doc_id"), "_size")).join(ranges, group).withColumn("at", F.col("_first") + F.col("_in"))
    piece = F.when(F.col("at") > 0, F.concat(F.lit(separator), "_text")).otherwise(F.col("_text"))
    parts = placed.select("date", F.floor(F.col("at") / part_chars).alias("_part"), F.struct("at", piece.alias("t")).alias("x")).groupBy("date", "_part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    first = F.get("xs", F.lit(0))["at"]
    start = F.when(first > 0, first - len(separator)).otherwise(first)
    body = F.array_join(F.transform("xs", lambda x: x["t"]), "")
    return parts.select("date", F.row_number().over(Window.partitionBy("date").orderBy("_part")).alias("part"), start.alias("start"), body.alias("body"))


def weekly(reports: DataFrame, days: int = 7, limit: int = 2000) -> DataFrame:
    return daily_concat(reports.filter(F.col("date").isin(latest_dates(reports, days))), limit)


def monthly(reports: DataFrame, month: str, limit: int = 3000, stride: int = 4, most: int = 10) -> DataFrame:
    """Of a month: the weekly reports if there are two or more, else every fourth day from the newest."""
    own = reports.filter(F.startswith("date", F.lit(month)))
    week = own.filter("report_type = 'ai-weekly'")
    if len(week.select("date", "doc_id").limit(2).collect()) == 2:
        return daily_concat(week, limit)
    dates = latest_dates(own, 31)[::stride][:most]
    return daily_concat(own.filter(F.col("date").isin(dates)), limit)


def _day_texts(reports: DataFrame, sources: Sequence[str], text: Column, separator: str) -> DataFrame:
    """(date, body): the given reports of each date in the order of ``sources``, at most one of each name."""
    place = ordinal(F.col("report_type"), sources)
    rows = reports.filter(F.col("report_type").isin(*sources)).select("date", F.struct(place.alias("o"), text.alias("t")).alias("x"))
    return rows.groupBy("date").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), separator).alias("body"))


def day_digests(reports: DataFrame, sources: Sequence[str], limit: int = 2500, notice: str = "\n...[摘要截断]") -> DataFrame:
    """Per date the sources' reports, each cut to ``limit`` characters with a notice."""
    return _day_texts(reports, sources, truncated(F.col("content"), limit, notice), "\n\n")


def week_digests(reports: DataFrame, sources: Sequence[str], days: int = 7) -> DataFrame:
    """The digests of the newest dates."""
    return day_digests(reports.filter(F.col("date").isin(latest_dates(reports, days))), sources)


def month_digests(reports: DataFrame, sources: Sequence[str], month: str, limit: int = 3000, notice: str = "\n...[截断]", stride: int = 4, most: int = 10) -> DataFrame:
    """Of a month: its weekly reports if two dates or more have one, else the digests of every fourth date from the
    newest."""
    own = reports.filter(F.startswith("date", F.lit(month)))
    week = own.filter("report_type = 'ai-weekly'")
    if len(latest_dates(week, 2)) == 2:
        return week.select("date", truncated(F.col("content"), limit, notice).alias("body"))
    return day_digests(own.filter(F.col("date").isin(latest_dates(own, stride * most)[::stride])), sources)


def digest_text(digests: DataFrame, head: str = "## ", separator: str = "\n\n---\n\n") -> DataFrame:
    """(first, last, text): some dates' digests as one text, newest first."""
    entry = F.struct("date", F.concat(F.lit(head), "date", F.lit("\n\n"), "body").alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(entry), asc=False), lambda x: x["t"]), separator)
    return digests.agg(F.min("date").alias("first"), F.max("date").alias("last"), text.alias("text"))


def social_text(reports: DataFrame, sources: Sequence[str], days: int = 1, limit: int = 3000) -> DataFrame:
    """(first, last, text) of the newest dates for an article: each report under its name."""
    text = F.concat(F.lit("## ["), "report_type", F.lit("]\n\n"), F.substring("content", 1, limit))
    newest = reports.filter(F.col("date").isin(latest_dates(reports, days)))
    return digest_text(_day_texts(newest, sources, text, "\n\n---\n\n"), "# ", "\n\n===\n\n")


def search_topics(pool: DataFrame) -> DataFrame:
    """Index rows of the pool: the source is the first evidence, 80 characters of it. Order is given where the index is
    written or asked (``keyword_search``): sorting all of it here would be a shuffle for nothing."""
    return pool.select("title", "category", "score", "action", F.coalesce(F.substring(F.get("evidence", F.lit(0)), 1, 80), F.lit("")).alias("source"))


def search_excerpts(reports: DataFrame, limit: int = 600) -> DataFrame:
    return reports.filter(~F.endswith("report_type", F.lit("-en"))).select("date", "report_type", "doc_id", F.substring("content", 1, limit).alias("excerpt"))


def state_counts(items: DataFrame) -> DataFrame:
    """Open and closed issues and pull requests of each repository ("closed" includes merged)."""
    c = lambda pr, state: F.count_if((F.col("is_pr") == pr) & (F.col("state") == state))
    return items.groupBy("repo").agg(c(False, "open").alias("open_issues"), c(False, "closed").alias("closed_issues"), c(True, "open").alias("open_prs"), c(True, "closed").alias("closed_prs"))


def merged_highlights(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("lang", "report")) -> DataFrame:
    """Old and new rows by key; new ones win."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_p"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")
