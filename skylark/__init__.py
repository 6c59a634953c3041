"""Skylark: signal ranking, retrieval and roll-ups as lazy Spark DataFrame operators."""
