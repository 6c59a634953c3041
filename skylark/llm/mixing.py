"""Mixing sources to target weights [native DataFrame functions only].

Sizes are summed for each source, the targets give each source a repetition rate, and every document is emitted
floor(rate) times plus one more copy when a hash-seeded Bernoulli draw falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import row_key, staged, table

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources are joined by broadcast (a few MB); beyond it Spark's own (skew-split) join is used.
MAX_BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def draw(key: Column, seed: str = SEED) -> Column:
    """In [0, 1): the first 8 hex digits of md5(seed:key)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: float = 3.0) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    Sources by code point, null last, take the weights in turn and share the total of all sizes; a target stops at
    ``max_repeat`` times its source's size and the excess goes to the others by weight until none is above. With
    sources ordered by cap / weight the capped ones are a prefix, so the level is found without a loop. Sources are
    numbered and summed in one task after they are aggregated: a row of some 50 bytes each, so millions are well.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weigh).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, every = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = lambda c: F.sum(c).over(every)
    per = per.withColumn("level", (left("source_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (left("w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(Window.partitionBy())["level"]
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("w"))
    per = per.select("source", "source_size", target.alias("target"))
    return per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def _with_copies(docs: DataFrame, key: str, source: str, text: str, keep: list[str]) -> DataFrame:
    sized = docs.select(*keep, F.col(key).alias("_key"), F.col(source).alias("_source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"))
    rates = staged(source_rates(sized.select(F.col("_source").alias("source"), F.col("_size").alias("size"))), "mix-rates")
    if rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    mixed = sized.join(rates, F.col("_source").eqNullSafe(F.col("source")))
    whole = F.floor("rate")
    return mixed.withColumn("_copies", (whole + (draw(row_key("_key")) < F.col("rate") - whole).cast("long")).cast("int"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with every row repeated by its source's rate; same columns. The draw depends on the key alone, so
    reruns agree and equal keys draw alike. A null source is a source of its own; null and wordless texts have size 0
    and are repeated at their source's rate (a source without words is left out); an empty table gives no rows."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(text).alias("_t"))
    copies = _with_copies(inner, "_k", "_s", "_t", ["_row"])
    return copies.filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_n")).select("_row.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = _with_copies(docs, "doc_id", "source", "text", [])
    return mixed.select(
        F.col("_key").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).cast("long").alias("taken")
    )


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), lv AS (
  SELECT arg_min(level, cap / w) AS level FROM levels WHERE level <= cap / w
), rates AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM lv), 0.0) * w)::DOUBLE AS target FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM rates
)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id, -9223372036854775808)::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""
