"""Reading inputs and cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a folder of our own, in local sessions only, for on a
    cluster each machine would have its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="skylark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables staged by this driver, oldest first, by application.
_STAGED: dict[str, list[str]] = {}


def _paths(spark: SparkSession) -> list[str]:
    return _STAGED.setdefault(spark.sparkContext.applicationId, [])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later reads neither recompute it nor
    depend on an executor's local disk. ``discard`` deletes such tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _paths(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far(spark: SparkSession) -> int:
    return len(_paths(spark))


def discard(spark: SparkSession, keep: int = 0, since: int = 0) -> None:
    """Delete the tables staged from number ``since`` on but the newest ``keep``: once a result is written, what it was
    made from can go. Frames that still read a deleted table fail."""
    paths = _paths(spark)
    old = paths[since : len(paths) - keep]
    for path in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del paths[since : since + len(old)]


def row_key(col: str = "doc_id"):
    """Ids as they are compared inside the operators: a null id comes before every other."""
    return F.coalesce(F.col(col).cast("long"), F.lit(-(2**63)).cast("long"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are staged already and referred to no more. Each of Spark's
    listeners holds the last event that it took, and with it the plan of the last write; a query of one row replaces it."""
    gc.collect()
    spark.sql("SELECT 1").collect()
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()
