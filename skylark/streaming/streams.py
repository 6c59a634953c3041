"""Structured Streaming forms of the incremental operators.

What must be known of each key stays in Spark's state store (``first_of_key``, ``crawl_diffs``): a batch asks for its own
keys only. Tables that are read as a whole (topics, daily best, latest values) are versioned by bucket
(``streaming/tables.py``): a batch rewrites the buckets that it touches. Either way a batch's work does not grow with the
batches before it, and a batch that runs again after a failure ends in the same state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.crawl import fresh_urls
from ..operators.graph import topic_id
from ..operators.ranking import top_per_group
from ..operators.scoring import score_signals
from ..rules import Rules
from . import tables

#: Groups that keys are dealt into, as many as tasks are to work on them; the state of a group is kept by key.
GROUPS = 16


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, a few for each trigger."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def score_stream(signals: DataFrame, now: Column, rules: Rules = Rules()) -> DataFrame:
    """Scoring is stateless: the batch expression on a stream."""
    return score_signals(signals, now, rules)


def dedup_stream(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row of each key that arrives within the watermark; keys are forgotten after it and later rows dropped.
    For keys that must not be lost however late they come use ``first_of_key``."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _sink(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _use_rocksdb(spark: SparkSession) -> None:
    """State on the executors' disks, with only changes written at each batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _grouped(rows: DataFrame, keys: Sequence[str], groups: int) -> DataFrame:
    """Rows with the group of their keys, for a state store that holds a map for each group."""
    _use_rocksdb(rows.sparkSession)
    return rows.withColumn("state_group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("long"))


def first_of_key(rows: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataStreamWriter:
    """A row of each key that no batch before has passed, however late it comes, to path/batch=n. The state store keeps
    the keys: a batch looks up its own and reads none of what was written. Null key columns count as a value. To forget
    keys after a time, at the price of later rows, use ``dedup_stream``."""
    _use_rocksdb(rows.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return _sink(rows.dropDuplicates(keys), checkpoint, write)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful steps of a query have dropped, as they came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])


class Crawled(StatefulProcessor):
    """Adds to each found URL what the state store has of it, and stores what was found."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = StructType([StructField("site", StringType()), StructField("url", StringType())])
        self.urls = handle.getMapState("urls", key, StructType([StructField("lastmod", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            old = []
            for site, url, lastmod in zip(some["site"], some["url"], some["lastmod"]):
                known = self.urls.getValue((site, url))
                old.append(known[0] if known else None)
                now = lastmod if isinstance(lastmod, str) else "seen"
                if now != old[-1]:
                    self.urls.updateValue((site, url), (now,))
            yield some.drop(columns="state_group", errors="ignore").assign(stored=pd.Series(old, dtype=object, index=some.index))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for site, url, lastmod in zip(initialState["site"], initialState["url"], initialState["lastmod"]):
            self.urls.updateValue((site, url), (lastmod if isinstance(lastmod, str) else "seen",))

    def close(self) -> None:
        pass


def crawl_diffs(found: DataFrame, state: DataFrame, path: str, checkpoint: str, metadata_only: Sequence[str] = (), first_run: int = 25, groups: int = GROUPS) -> DataStreamWriter:
    """The crawl diff of each batch (path/new/batch=n) against all URLs known so far, which the state store keeps by site
    and URL and which start as ``state`` (site, url, lastmod). Known sites are a small table of their own."""
    known = ["site", "url"]
    schema = StructType([*found.schema.fields, StructField("stored", StringType())])
    begun = _grouped(state.select("site", "url", "lastmod"), known, groups).groupBy("state_group")
    seen = _grouped(found, known, groups).groupBy("state_group").transformWithStateInPandas(Crawled(), schema, "Update", "None", begun)
    sites = f"{path}/sites"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch == 0:
            tables.write_version(state.select("site").distinct(), sites, -1)
        before = tables.read_version(spark, sites, epoch - 1)
        batch = batch.withColumnRenamed("stored", "_old").persist()  # asked twice
        try:
            fresh_urls(batch, before, metadata_only, first_run).write.mode("overwrite").parquet(f"{path}/new/batch={epoch}")
            tables.write_version(before.union(batch.select("site")).distinct(), sites, epoch)
        finally:
            batch.unpersist()

    return _sink(seen, checkpoint, write)


def crawl_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(site, url, lastmod) as the state store of ``crawl_diffs`` has it after its last batch."""
    rows = spark.read.format("statestore").option("stateVarName", "urls").load(checkpoint)
    return rows.select("user_map_key.site", "user_map_key.url", "user_map_value.lastmod")


def merge_topics(app: DataFrame, path: str, checkpoint: str, buckets: int = tables.BUCKETS) -> DataStreamWriter:
    """Topic nodes kept up to date: the batch's aggregate merged with the nodes of its buckets; name and category are
    those written last."""
    columns = ["topic_id", "last.ord", "last.name", "last.category", "total_score", "mention_count", "first_seen", "last_seen"]

    def write(batch: DataFrame, epoch: int) -> None:
        last = F.struct("ord", F.trim("title").alias("name"), "category")
        new = batch.groupBy(topic_id()).agg(F.max(last).alias("last"), F.max("score").alias("total_score"), F.count("*").alias("mention_count"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))

        def merge(rows: DataFrame) -> DataFrame:
            both = rows.groupBy("topic_id").agg(F.max(F.struct("ord", "name", "category")).alias("last"), F.max("total_score").alias("total_score"), F.sum("mention_count").alias("mention_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
            return both.select(columns)

        tables.merge(new.select(columns), path, epoch, tables.by_key(["topic_id"], buckets), merge)

    return _sink(app, checkpoint, write)


def daily_top(scored: DataFrame, path: str, checkpoint: str, keep: Sequence[str], ts: str = "ts", limit: int = 60, order: Sequence[str] = ("src_ord", "item_ord"), late_days: int = 2) -> DataStreamWriter:
    """The best ``limit`` rows of each day of event time, a bucket a day: (day, keep, score, order, rank).

    A day is closed once rows ``late_days`` beyond its end have come in an earlier batch. Closed days are never written
    again; rows that come for them go to path/late/batch=n. ``order`` tells rows apart. Rows without a time are late."""
    day = F.date_format(ts, "yyyy-MM-dd")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("day", day).select("day", *keep, "score", *order, ts)
        clock = tables.clock(spark, path, epoch)
        rows = rows.persist()  # asked three times
        try:
            newest = rows.agg(F.max(ts)).first()[0]
            closed = F.lit(False) if clock is None else F.col("day").cast("date") < F.date_sub(F.lit(clock).cast("date"), late_days)
            is_late = F.col("day").isNull() | closed
            rows.filter(is_late).drop(ts).write.mode("overwrite").parquet(f"{path}/late/batch={epoch}")

            def merge(both: DataFrame) -> DataFrame:
                one = both.dropDuplicates(["day", *order])  # a batch that runs again meets its own rows
                return top_per_group(one, "day", limit, [F.desc("score"), *order])

            own = rows.filter(~is_late).drop(ts)
            now = max((x for x in (clock, newest.isoformat() if newest else None) if x), default=None)
            tables.merge(own, path, epoch, F.col("day"), merge, drop=("rank",), clock=now)
        finally:
            rows.unpersist()

    return _sink(scored, checkpoint, write)


def upsert_sink(stream: DataFrame, keys: list[str], path: str, checkpoint: str, buckets: int = tables.BUCKETS) -> DataStreamWriter:
    """The last written row of each key (``tables.current``): a batch's rows replace those of their keys in the buckets of
    these keys. A batch holds one row of a key."""

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in keys]

        def merge(rows: DataFrame) -> DataFrame:
            return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("r")).select(*keys, "r.*")

        tables.merge(batch, path, epoch, tables.by_key(keys, buckets), merge, fresh="_new")

    return _sink(stream, checkpoint, write)
