"""Incremental crawl: what a sitemap shows that the state table does not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crawl_diff(found: DataFrame, state: DataFrame, metadata_only: Sequence[str] = (), first_run: int = 25) -> DataFrame:
    """New URLs: unseen, or with a later lastmod than stored (string order), but for sites that only count unseen ones.
    Of a site without any state the newest ``first_run`` come."""
    known = state.select("site", "url", F.col("lastmod").alias("_old"))
    return fresh_urls(found.join(known, ["site", "url"], "left").select(*found.columns, "_old"), state.select("site").distinct(), metadata_only, first_run)


def fresh_urls(rows: DataFrame, sites: DataFrame, metadata_only: Sequence[str] = (), first_run: int = 25) -> DataFrame:
    """The new URLs of rows that carry the stored lastmod in ``_old`` (null: unseen); ``sites`` are those with a state."""
    columns = [c for c in rows.columns if c != "_old"]
    rows = rows.join(sites.withColumn("_known", F.lit(True)), "site", "left")
    newer = F.col("_old").isNotNull() & ~F.col("site").isin(*metadata_only) & (F.col("lastmod") > F.col("_old"))
    fresh = rows.filter(F.col("_old").isNull() | newer)
    w = Window.partitionBy("site").orderBy(F.desc_nulls_last("lastmod"), "url")
    ranked = fresh.filter("_known IS NULL").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first_run).drop("_n")
    return fresh.filter("_known").unionByName(ranked).select(*columns, F.coalesce("_known", F.lit(False)).alias("known_site"))


def next_state(found: DataFrame, state: DataFrame) -> DataFrame:
    """Everything found is stored, "seen" where it has no lastmod; the rest of the state stays."""
    new = found.select("site", "url", F.coalesce("lastmod", F.lit("seen")).alias("_new"))
    return state.join(new, ["site", "url"], "full").select("site", "url", F.coalesce("_new", "lastmod").alias("lastmod"))


def crawl_summary(found: DataFrame, diff: DataFrame) -> DataFrame:
    """New and total counts of each site, and of all (site null)."""
    total = found.rollup("site").agg(F.count("*").alias("total"))
    new = diff.rollup("site").agg(F.count("*").alias("new"), F.bool_or(~F.col("known_site")).alias("first_run"))
    return total.join(new, total.site.eqNullSafe(new.site), "left").select(total.site, "total", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("first_run", F.lit(False)).alias("first_run"))
