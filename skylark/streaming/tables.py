"""Tables that batches merge into, bucket by bucket.

data/version=n/bucket=b holds a bucket as batch n left it, heads/version=n the newest version of every bucket. A batch
reads and writes its own buckets only, then the heads. What neither the last heads nor those before them name is
deleted, so readers of the last version go on while a batch runs, and a batch that runs again starts from the same heads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import children, delete

#: Buckets of a table unless it is to grow beyond some millions of rows; fixed when the table is made.
BUCKETS = 16
HEADS = "bucket string, version int, clock string"


def by_key(keys: Sequence[str], buckets: int) -> Column:
    return F.format_string("%05d", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


def _heads(spark: SparkSession, path: str, before: int) -> tuple[dict[str, int], str | None, int | None]:
    """The heads (bucket to version), clock and number of the newest version below ``before``; a row for each bucket."""
    versions = [int(n.partition("=")[2]) for n in children(spark, f"{path}/heads") if n.startswith("version=")]
    done = [v for v in versions if v < before and "_SUCCESS" in children(spark, f"{path}/heads/version={v}")]
    if not done:
        return {}, None, None
    rows = spark.read.schema(HEADS).parquet(f"{path}/heads/version={max(done)}").collect()
    return {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}, next((r["clock"] for r in rows if r["clock"]), None), max(done)


def clock(spark: SparkSession, path: str, epoch: int) -> str | None:
    """The clock that the batch before ``epoch`` has left."""
    return _heads(spark, path, epoch)[1]


def merge(rows: DataFrame, path: str, epoch: int, bucket: Column, merged: Callable[[DataFrame], DataFrame], drop: Sequence[str] = (), fresh: str | None = None, clock: str | None = None) -> list[str]:
    """Replace the buckets of ``rows`` by ``merged`` (their stored rows and ``rows``); returns these buckets. ``drop``:
    columns that ``merged`` makes anew. ``fresh``: a column that is true for ``rows`` and false for stored ones."""
    spark = rows.sparkSession
    heads, _, last = _heads(spark, path, epoch)
    rows = rows.withColumn("bucket", bucket).persist()  # asked twice
    try:
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # no more than there are buckets
        if touched:
            old = [f"{path}/data/version={heads[b]}/bucket={b}" for b in touched if b in heads]
            mark = lambda df, new: df.withColumn(fresh, F.lit(new)) if fresh else df
            both = mark(rows.drop("bucket"), True)
            if old:
                stored = spark.read.option("basePath", f"{path}/data").parquet(*old).drop("bucket", "version", *drop)
                both = both.unionByName(mark(stored, False))
            out = merged(both).withColumn("bucket", bucket)
            out.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/data/version={epoch}")
    finally:
        rows.unpersist()
    after = heads | dict.fromkeys(touched, epoch)
    spark.createDataFrame([(b, v, clock) for b, v in after.items()] or [(None, None, clock)], HEADS).coalesce(1).write.mode("overwrite").parquet(f"{path}/heads/version={epoch}")
    _retire(spark, path, epoch, last, heads, after)
    return touched


def _retire(spark: SparkSession, path: str, epoch: int, last: int | None, before: dict[str, int], after: dict[str, int]) -> None:
    needed = {*before.items(), *after.items()}
    named = {v for _, v in needed}
    for name in children(spark, f"{path}/data"):
        v = int(name.partition("=")[2])
        if v not in named:
            delete(spark, f"{path}/data/{name}")
        elif v < epoch:
            for b in children(spark, f"{path}/data/{name}"):
                if b.startswith("bucket=") and (b.partition("=")[2], v) not in needed:
                    delete(spark, f"{path}/data/{name}/{b}")
    for name in children(spark, f"{path}/heads"):
        if int(name.partition("=")[2]) not in (last, epoch):
            delete(spark, f"{path}/heads/{name}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last batch left it."""
    heads, _, _ = _heads(spark, path, 1 << 31)
    if not heads:
        raise FileNotFoundError(f"no batch has written to {path}")
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}/bucket={b}" for b, v in sorted(heads.items())]).drop("bucket", "version")


def write_version(df: DataFrame, path: str, epoch: int) -> None:
    """A small table as a whole; the last two versions stay."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={epoch}")
    for name in children(df.sparkSession, path):
        if int(name.partition("=")[2]) < epoch - 1:
            delete(df.sparkSession, f"{path}/{name}")


def read_version(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={epoch}")
