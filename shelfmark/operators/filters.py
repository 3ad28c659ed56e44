"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_min(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Rows whose ``column`` reaches ``minimum``: a count, or a bucket derived before.

    On a derived column Catalyst rewrites the test to the source column, so it reaches the scan.
    """
    return df.filter(F.col(column) >= minimum)


def drop_nulls_subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have all of ``columns``; a NaN counts as missing.

    Plain null tests, unlike the counting test of ``na.drop``, reach the scan and turn an outer join
    below into an inner one.
    """
    floating = {name for name, dtype in df.dtypes if dtype in ("double", "float")}
    for name in columns:
        present = F.col(name).isNotNull()
        df = df.filter(present & ~F.isnan(name) if name in floating else present)
    return df


def filter_nonblank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is there and not blank."""
    # One test, which a null fails too: a computed column is then computed once for it.
    return df.filter(F.trim(F.col(column)) != "")
