"""Ship the package to the executors, for drivers that import it from a folder of their own."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_skylark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='skylark-')}/skylark", "zip", here.parent, here.name)
    context.addPyFile(archive)
    context._skylark_shipped = True
