"""Queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Tables that several queries of a session read, by application, input and name.
_STORED: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place that ``spark.checkpoint.dir`` names; only a local session may do without."""
    return f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """The path of a table that ``build`` writes there once in an application: an index is built once and asked often."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch(spark)
        build(path)
        _STORED[key] = path
    return _STORED[key]
