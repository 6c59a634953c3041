"""The corpus pipeline: each stage's rows are written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from skylark.llm._stage import discard, staged, staged_so_far, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on all labels scores at one half or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles, the one of least id stays."""
    return jaccard_join.first_of_each(docs, width=5, num=80, den=100).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources come near their target shares."""
    return mixing.mix(docs).select(COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document (and repeat) with its shard and place in it."""
    return sharding.assign_shards(docs).withColumn("law", F.lit("bytes"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", shard)]

#: Training and hashed orders are not SQL; tests/llm checks the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is written; then all that it was made from is deleted, but what was
    staged before this call."""
    docs, kept = table(spark, sf_dir, "documents"), staged_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, keep=1, since=kept)
    return STAGES[-1][1](spark, docs, sf_dir)
