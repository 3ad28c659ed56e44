"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder

    def path(self, name: str) -> str:
        return f"{self._folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` as a query, with SQL unless it has none."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_settings(spark)  # also where the session was made without them
            return f(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def rounded(col: Column | str, digits: int = 6) -> Column:
    """A floating result, rounded for comparison."""
    return F.round(col, digits)


def day(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def sql_list(words) -> str:
    """Words as a SQL list."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
