"""Registration of queries: a name, a function of (spark, sf_dir), and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.operators.snapshots import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function, and its SQL if there is one."""

    def keep(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


def derived(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query derives from tables."""
    return shared_folder(spark, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
