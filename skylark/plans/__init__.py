"""Queries over the driver's tables, with their SQL."""

from . import signal_queries, store_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
