"""Full text: an inverted index (term, key, tf, len) that is built once and read by term, and BM25 over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import children

#: What separates words.
GAP = r"[^\p{L}\p{N}]+"
#: Text of a range of the index: about 2 M postings, 100 MB to sort.
RANGE_CHARS = 16 << 20


def _with(value: Column, of: Callable[[Column], Column]) -> Column:
    """What ``of`` makes of a value that is reckoned once for a row, however often it is asked."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def counted(words: Column) -> Column:
    """(term, tf, len) of each word of a list once, and the list's length: sorted, and counted by where the next begins."""
    begins = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    rows = lambda w, at: F.transform(at, lambda i, j: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(w)) - i).cast("long").alias("tf"), F.size(w).alias("len")))
    return _with(F.sort_array(words), lambda w: _with(begins(w), lambda at: rows(w, at)))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, len, tf): each word of each text once. ``key`` is unique; rows without a text are not documents, and
    ``len`` counts what ``GAP`` leaves, empty strings at the ends included. A text is split once and its words are counted
    in its own row, so nothing is moved or held for it."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(counted(F.split(F.lower(text), GAP))).alias("_p"))
    return rows.select("_p.term", "key", "_p.len", "_p.tf")


def write_index(docs: DataFrame, path: str, key: str, text: str) -> None:
    """Add documents of new keys to the index at ``path``: their postings (``postings/part=n``) in ranges of (term, key),
    so a term's rows lie together however common it is, in files and row groups that its statistics let a reader skip;
    and their number and words (``size/part=n``). There is a range for each ``RANGE_CHARS`` of text, so no task's share
    grows with the documents."""
    spark = docs.sparkSession
    part = len(children(spark, f"{path}/size"))  # what a broken attempt has left is written over
    given = docs.filter(F.col(text).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).first()
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), given["chars"] // RANGE_CHARS + 1)
    rows = postings(docs, key, text).repartitionByRange(spread, "term", "key").sortWithinPartitions("term", "key")
    rows.select("term", "key", "tf", "len").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings/part={part}")
    words = spark.read.parquet(f"{path}/postings/part={part}").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
    words.select(F.lit(given["n"]).cast("long").alias("n"), "words").write.mode("overwrite").parquet(f"{path}/size/part={part}")  # one row


def read_postings(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """Postings of some terms: a filter that reaches the scan."""
    return spark.read.parquet(f"{path}/postings").filter(F.col("term").isin([t.lower() for t in terms]))


def score(rows: DataFrame, size: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): BM25 of postings of the asked terms; size has one row (n, words). Document frequencies are counted
    from the same postings, a row for each term."""
    common = rows.groupBy("term").agg(F.count("*").alias("df"))
    whole = size.agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avg_len")).select(F.struct("*")).scalar()
    idf = F.log(1 + (whole["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / whole["avg_len"]))
    return rows.join(F.broadcast(common), "term").groupBy("key").agg(F.sum(part).alias("score"))


def search(spark: SparkSession, path: str, terms: Sequence[str], key: str = "key") -> DataFrame:
    """(key, score) of the documents of a written index that hold a term."""
    return score(read_postings(spark, path, terms), spark.read.parquet(f"{path}/size")).withColumnRenamed("key", key)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, cf): in how many documents and how often each word occurs. Files are ranges of terms already."""
    return spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(docs: DataFrame, terms: Sequence[str], key: str, text: str) -> DataFrame:
    """(key, score) of the rows that hold a term, without an index: one pass keeps the asked words of each text only."""
    words = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.split(F.lower(text), GAP).alias("_w"))
    asked = F.array(*[F.lit(t.lower()) for t in terms])
    rows = words.select("key", F.size("_w").alias("len"), F.explode(F.filter("_w", lambda w: F.array_contains(asked, w))).alias("term"))
    rows = rows.groupBy("key", "len", "term").agg(F.count("*").alias("tf"))
    size = words.agg(F.count("*").alias("n"), F.sum(F.size("_w")).alias("words"))
    return score(rows, size).withColumnRenamed("key", key)
