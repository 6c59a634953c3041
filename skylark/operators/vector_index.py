"""A stored index of vectors in cells, for approximate search by cosine distance with exact distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import near_in_group, valid_vectors, vector_topk_batch

#: Vectors that cells are fitted on (those of least hash) and numbers that all centres hold, at most.
FIT_ROWS, CENTRE_NUMBERS = 16384, 1 << 21
#: Rows and queries of a group; blocks that lie in one file.
BLOCK_ROWS, GROUP_QUERIES, FILE_BLOCKS = 8192, 256, 16
#: Rows whose exact neighbours the number of cells to ask is chosen by.
TRIAL_ROWS = 128


@dataclass
class VectorIndex:
    """Rows lie at ``path`` by cell. Vectors of the commonest length lie in the cell of their nearest centre; each other
    length is a cell of its own (minus the length), always asked whole."""

    path: str
    centres: np.ndarray
    blocks: dict[int, int]  # of each cell
    probes: int = 0
    recall: float = 1.0  # of the trial rows

    def cells(self, v: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        like = v @ self.centres.T
        if n == 1:
            return like.argmax(1)[:, None]
        return np.argsort(-like, axis=1, kind="stable")[:, :n]


def _placed(index: VectorIndex, n: int):
    """(vec_id, embedding, cells): the n nearest cells of each vector."""
    dim = index.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column(1).offsets.to_numpy())
            cells = (-size[:, None]).tolist()
            own = np.flatnonzero(size == dim)
            if len(own):
                v = b.column(1).take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim)
                for i, c in zip(own.tolist(), index.cells(v, n).tolist()):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.list_(pa.int32()))], names=["vec_id", "embedding", "cells"])

    return lambda df: df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, cells array<int>")


def build(rows: DataFrame, path: str, recall: float = 0.95, k: int = 10, seed: int = 7) -> VectorIndex:
    """Index every valid row of (vec_id, embedding) at ``path``; ids are unique.

    About sqrt(rows) cells are fitted by k-means on at most ``FIT_ROWS`` vectors of least hash. How many cells a query
    asks is chosen by measuring: ``TRIAL_ROWS`` rows of least hash are searched exactly among all rows, and the fewest
    nearest cells that hold ``recall`` of their k nearest are asked. Null, zero and non-finite vectors are left out."""
    spark, v = rows.sparkSession, valid_vectors(rows)
    sizes = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim, count = (sizes[0]["dim"], sizes[0]["count"]) if sizes else (1, 0)
    least = v.filter(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id")
    k_cells = max(1, min(int(count**0.5), CENTRE_NUMBERS // dim, FIT_ROWS // 4))
    index = VectorIndex(path, np.zeros((1, dim)), {})
    if k_cells > 1:
        fit = least.limit(FIT_ROWS).select(array_to_vector("embedding").alias("v"))
        model = KMeans(k=k_cells, featuresCol="v", distanceMeasure="cosine", maxIter=10, seed=seed).fit(fit)
        centres = np.array(model.clusterCenters())
        index.centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    placed = _placed(index, 1)(v).select("vec_id", "embedding", F.element_at("cells", 1).alias("cell"))
    index.blocks = {r["cell"]: -(-r["count"] // BLOCK_ROWS) for r in placed.groupBy("cell").count().collect()}  # a row for each cell
    blocks = _blocks(spark, index)
    dealt = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks")
    dealt.repartition("cell", F.floor(F.col("block") / FILE_BLOCKS)).write.partitionBy("cell").parquet(path)
    index.probes = len(index.centres)
    trial = least.limit(TRIAL_ROWS)
    if k_cells > 1:
        near = vector_topk_batch(v, trial, k)
        home = stored_rows(spark, index).select("vec_id", "cell")
        asked = _placed(index, len(index.centres))(trial).select(F.col("vec_id").alias("query_id"), "cells")
        ranks = near.join(home, "vec_id").join(F.broadcast(asked), "query_id").select(F.array_position("cells", F.col("cell")).alias("n")).collect()  # k of each trial row
        need = np.sort([r["n"] for r in ranks])
        if len(need):
            index.probes = int(need[max(0, int(np.ceil(recall * len(need))) - 1)])
            index.recall = float((need <= index.probes).mean())
    return index


def _blocks(spark: SparkSession, index: VectorIndex) -> DataFrame:
    return spark.createDataFrame(list(index.blocks.items()), "cell int, blocks int")


def stored_rows(spark: SparkSession, index: VectorIndex) -> DataFrame:
    return spark.read.schema("vec_id long, embedding array<double>, block int, cell int").parquet(index.path)


def nearest(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest rows but the query's own in the cells that it asks, by exact cosine
    distance, ties by id. Queries are (vec_id, embedding), in any number; those without a distance take no part. With
    ``probes`` of all cells the search is exact.

    Rows of cells that nobody asks are not read. Queries and rows meet by cell, in groups of about ``GROUP_QUERIES`` by
    ``BLOCK_ROWS``, however many rows a cell holds."""
    spark = queries.sparkSession
    q = _placed(index, probes or index.probes)(valid_vectors(queries)).select("vec_id", "embedding", F.explode("cells").alias("cell"))
    asks = {r["cell"]: -(-r["count"] // GROUP_QUERIES) for r in q.groupBy("cell").count().collect() if r["cell"] in index.blocks}  # a row for each cell
    wide = F.broadcast(spark.createDataFrame(list(asks.items()), "cell int, parts int"))
    at = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = ["cell", "block", "part"]
    left = stored_rows(spark, index).filter(F.col("cell").isin(list(asks))).join(wide, "cell").select("vec_id", "embedding", "cell", "block", at("parts").alias("part"))
    right = q.join(wide, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).join(F.broadcast(_blocks(spark, index)), "cell")
    right = right.select("vec_id", "embedding", "cell", at("blocks").alias("block"), "part")
    near = left.groupBy(group).cogroup(right.groupBy(group)).applyInArrow(near_in_group(k), "query_id long, vec_id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
