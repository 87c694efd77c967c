"""The registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def values(spark: SparkSession, sf_dir: str, rows: str) -> DataFrame:
    """Rows that a query over ``events`` derives, the same text for both engines."""
    text = rows.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return spark.sql(f"SELECT * FROM {text}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
