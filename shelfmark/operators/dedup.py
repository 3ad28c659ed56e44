"""De-duplication with an explicit survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.rank import top_per_group


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per ``keys``, the first by ``order``; rows without a key count as equal.

    Each task keeps one row per key before the shuffle, so copies of one key never meet in one task.
    """
    return top_per_group(df, keys, order, 1, rank="_first").drop("_first")


def dedup_by_id(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per id, the first by ``order``."""
    return dedup_keep_first(df, [key], order)


def quarantine_missing(df: DataFrame, key: str, corrupt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with a readable record and a key, and the others."""
    good = F.col(key).isNotNull()
    if corrupt is not None:
        good = good & F.col(corrupt).isNull()
    return df.filter(good), df.filter(~good)
