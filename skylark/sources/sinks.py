"""Writers of the engine's tables and export files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def overwrite_dates(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ("date",)) -> None:
    """Replace the partitions that ``df`` holds and leave the others (pool, index, chunk store and state tables)."""
    df.repartition(*by).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").format(fmt).save(path)


def write_search_index(index: DataFrame, path: str) -> None:
    """The search index under ``date=`` folders; days are balanced by size, so a day of any size takes several tasks. A
    day that is written again is replaced."""
    index.hint("rebalance", "date").write.partitionBy("date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_search_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.withColumn("date", F.col("date").cast("string"))


def write_pool(candidates: DataFrame, path: str) -> None:
    """The daily pool as JSON lines, one folder for each date."""
    overwrite_dates(candidates, path, "json")


def write_pool_files(candidates: DataFrame, path: str) -> None:
    """The daily pools as documents: one JSON object a date and file, its candidates in an array (some 60 a day; larger
    days are cut into several documents of at most 10,000 candidates)."""
    item = F.struct(*[c for c in candidates.columns if c != "date"])
    part = F.floor((F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"))) - 1) / 10_000)
    pools = candidates.select("date", part.alias("_part"), item.alias("c")).groupBy("date", "_part").agg(F.sort_array(F.collect_list("c")).alias("candidates")).drop("_part")
    overwrite_dates(pools, path, "json")


def write_reports(reports: DataFrame, path: str) -> None:
    """Report texts under date= and report_type= folders, one text file for each report."""
    rows = reports.select("date", "report_type", F.col("content").alias("value"))
    rows.repartition("date", "report_type").write.partitionBy("date", "report_type").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").mode("overwrite").text(path)


def write_small_json(df: DataFrame, path: str) -> None:
    """Manifest, feed rows or highlights: bounded by design, so one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Node, edge and state tables, clustered by key for later joins and pruning."""
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.partitionBy("date").mode("append").parquet(path)
