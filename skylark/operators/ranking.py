"""Dedup, top-N, paging and sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def early_cut(df: DataFrame, n: int, arrival: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first n rows in order of arrival, then sorted."""
    return df.orderBy(*arrival).limit(n).orderBy(*order)


def top_per_group(df: DataFrame, group: str, caps: dict[str, int] | int, order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """The first rows of each group, as many as its cap (groups without one are left out)."""
    w = Window.partitionBy(group).orderBy(*order)
    if isinstance(caps, int):
        return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= caps)
    ranked = df.filter(F.col(group).isin(*caps)).withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= max(caps.values()))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(group)]
    return ranked.filter(F.col(rank) <= cap)


def page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def all_of(*tests: Column | None) -> Column:
    """Conjunction of the tests that are given."""
    out = F.lit(True)
    for t in tests:
        out = out if t is None else out & t
    return out


def recent(df: DataFrame, column: str, now: Column, newest: str = "0 hours", oldest: str = "24 hours") -> DataFrame:
    """Rows of the last ``oldest`` but not of the last ``newest``."""
    ts = F.col(column)
    return df.filter((ts > now - F.expr(f"INTERVAL {oldest}")) & (ts <= now - F.expr(f"INTERVAL {newest}")))


def stale(df: DataFrame, now: Column, days: int) -> DataFrame:
    """Open items created before now - days, oldest first."""
    return df.filter((F.col("state") == "open") & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS"))).orderBy("created_at", "number")
