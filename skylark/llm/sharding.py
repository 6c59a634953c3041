"""Sharding by sampled splitters [native DataFrame functions only].

Records are ordered by (text hash, id); rows that repeat both are one record with a count. Size-weighted samples of
that key give quantile boundaries; the boundaries cut the key space into fine ranges, as many as the records ask for;
ranges that turn out overfull are sampled again, all in one job, and subdivided until none is. Every range is then one
sort of about ``RANGE_ROWS`` records, and exact byte offsets (range prefix + running sum inside the range) put each row
into its shard, so shard sizes differ by about one row however skewed the keys are. Equal texts have neighbouring keys
and share a shard unless a shard boundary falls inside their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import row_key, staged, table

#: Records sampled for each fine range, in expectation.
SAMPLES_PER_RANGE = 24
#: A range is overfull beyond this many times its share of the bytes.
OVERFULL = 3.0
#: Fine ranges: so many for each shard at least, and one for so many records, up to a bound on what the driver sees
#: (its sort then spills); rows of one record that are written out by one task.
RANGES_PER_SHARD, RANGE_ROWS, MAX_RANGES = 8, 1_000_000, 8192
REPEATS = 100_000
#: Records of a range at least, on average: fewer would be overfull by chance.
LEAST_RANGE = 64


def _unit(*cols, seed: int) -> Column:
    """A number in [0, 1) from a hash of the columns; the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _splitters(rows: list, ranges: int) -> list[tuple[int, int]]:
    """Weighted quantiles of the sampled (h, id, weight) rows; at most ``ranges - 1`` keys."""
    rows = sorted((r["h"], r["k"], r["w"]) for r in rows)
    total, run, out = sum(r[2] for r in rows), 0.0, []
    for h, k, w in rows:
        run += w
        if run >= total * (len(out) + 1) / ranges and len(out) < ranges - 1 and (not out or out[-1] < (h, k)):
            out.append((h, k))
    return out


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are below the key: two-level search over literal arrays, about 2 sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    width = max(1, int(len(splitters) ** 0.5))
    key = F.struct(F.col("h").alias("h"), F.col("k").alias("k"))
    lit = lambda p: F.struct(F.lit(p[0]).cast("long").alias("h"), F.lit(p[1]).cast("long").alias("k"))
    heads = F.array(*[lit(p) for p in splitters[::width]])
    blocks = F.array(*[F.array(*[lit(p) for p in splitters[i : i + width]]) for i in range(0, len(splitters), width)])
    head = F.size(F.filter(heads, lambda x: x < key))
    inside = F.size(F.filter(F.element_at(blocks, F.greatest(head, F.lit(1))), lambda x: x < key))
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * width + inside).cast("int")


def assign_shards(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """One row for each row of ``docs``: (key, size, text_crc32, shard, slot).

    Size is the UTF-8 length of the text (null: 0) plus 8. Null keys sort first, null texts hash like a text of
    their own; rows that repeat both key and text are interchangeable and get neighbouring slots. An empty table gives an empty result. Extra
    columns of ``docs`` are not read. Splitter samples are the only rows the driver sees: about
    ``SAMPLES_PER_RANGE`` for each range, whatever the input size.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    slim = docs.select(F.col(key).alias("id"), row_key(key).alias("k"), F.xxhash64(text).alias("h"), size.alias("size"), F.crc32(F.encode(F.col(text), "UTF-8")).alias("crc"))
    slim = staged(slim.groupBy("id", "k", "h", "size", "crc").agg(F.count("*").alias("c")).withColumn("b", F.col("size") * F.col("c")), "shard-keys")
    total, records, most = slim.agg(F.sum("b"), F.count("*"), F.max("c")).first()
    if not records:
        return slim.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    ranges = int(min(max(shards * RANGES_PER_SHARD, records // RANGE_ROWS), MAX_RANGES, max(1, records // LEAST_RANGE)))
    step = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    sample = slim.filter(_unit("k", "h", seed=seed) * step < F.col("b")).select("h", "k", F.greatest("b", F.lit(step)).alias("w"))
    cuts = _splitters(sample.collect(), ranges)
    while True:  # subdivide overfull ranges, each from a sample of its own
        seed += 1
        r = slim.withColumn("r", _range_of(cuts))
        full = r.groupBy("r").agg(F.sum("b").alias("rb"), F.count("*").alias("n")).filter((F.col("rb") > OVERFULL * total / ranges) & (F.col("n") > 1)).drop("n")
        full = full.collect()  # at most ranges / OVERFULL rows
        want = {f["r"]: int(f["rb"] * ranges / total) + 1 for f in full}
        wide = docs.sparkSession.createDataFrame([(f["r"], max(1.0, f["rb"] / (want[f["r"]] * SAMPLES_PER_RANGE))) for f in full], "r int, s double")
        drawn = r.join(F.broadcast(wide), "r").filter(_unit("k", "h", seed=seed) * F.col("s") < F.col("b")).select("r", "h", "k", F.greatest("b", "s").alias("w")).collect() if full else []
        more = {cut for f in want for cut in _splitters([d for d in drawn if d["r"] == f], want[f])} - set(cuts)
        if not more:  # none is overfull, or those are single records
            break
        cuts = sorted({*cuts, *more})
    ranged = slim.withColumn("r", _range_of(cuts))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, a bounded number
    base = ranged.groupBy("r").agg(F.sum("b").alias("b"), F.sum("c").alias("n")).select("r", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("r").orderBy("h", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("id", "h", "size", "crc", "r", "c", F.coalesce(F.sum("c").over(inside), F.lit(0)).alias("i"), F.coalesce(F.sum("b").over(inside), F.lit(0)).alias("run")).join(F.broadcast(base), "r")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    if most > REPEATS:  # the rows of one record are written out by several tasks
        first = F.col("_part") * REPEATS
        placed = placed.withColumn("_part", upto(F.ceil(F.col("c") / REPEATS))).repartition("h", "_part")
        placed = placed.withColumn("_j", F.explode(F.sequence(first, F.least(first + REPEATS, F.col("c")) - 1)))
    elif most > 1:
        placed = placed.withColumn("_j", upto(F.col("c")))
    else:
        placed = placed.withColumn("_j", F.lit(0).cast("long"))
    middle = 2 * (F.col("b0") + F.col("run") + F.col("_j") * F.col("size")) + F.col("size")
    placed = staged(
        placed.select("id", "size", "crc", (F.col("n0") + F.col("i") + F.col("_j")).alias("at"), F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2 * total))).cast("int").alias("shard")),
        "shard-places",
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("first")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, key: str = "doc_id") -> None:
    """Write ``docs`` with a folder for each shard, ordered by slot; the key must be unique."""
    places = assign_shards(docs, shards, key=key).select(key, F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    (docs.join(places, key).repartition(F.col("_shard"), F.floor(F.col("_slot") / 100_000)).sortWithinPartitions("_shard", "_slot")
     .withColumnRenamed("_shard", "shard").drop("_slot").write.partitionBy("shard").parquet(path))


def op2_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
