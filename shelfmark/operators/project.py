"""Projections: re-typing and cleaning of whole columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import columns as C
from shelfmark.schema import MISSING_DATE, SENTINELS


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def cast_numeric(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Re-type columns; unreadable values become null."""
    return df.withColumns({name: F.col(name).try_cast(dtype) for name, dtype in types.items()})


def strip_chars(df: DataFrame, chars: Mapping[str, str]) -> DataFrame:
    """Delete characters from text columns: ``{column: characters}``."""
    return df.withColumns({name: C.strip_chars(F.col(name), drop) for name, drop in chars.items()})


def floor_bucket(df: DataFrame, score: str, bucket: str) -> DataFrame:
    """Add ``bucket``, the whole part of ``score``."""
    return df.withColumn(bucket, C.floor_bucket(F.col(score)))


def select_alias(df: DataFrame, columns: Mapping[str, str] | Iterable[str]) -> DataFrame:
    """Keep the named columns; a mapping ``{old: new}`` renames them."""
    if isinstance(columns, Mapping):
        return df.select(*(F.col(old).alias(new) for old, new in columns.items()))
    return df.select(*columns)


def prefix_path(df: DataFrame, path: str, base: str) -> DataFrame:
    """Put ``base`` in front of a path column."""
    return df.withColumn(path, C.prefix_path(F.col(path), base))


def date_parts(
    df: DataFrame, date: str, prefix: str, fmt: str = "yyyy-MM-dd", missing: str = MISSING_DATE
) -> DataFrame:
    """Parse a text date and add ``<prefix>_year``, ``_month`` and ``_day``; no date gives nulls.

    ``missing`` is the text that stands for an unknown date.
    """
    parsed = C.parsed_date(F.nullif(F.col(date), F.lit(missing)), fmt)
    return df.withColumn(date, parsed).withColumns({
        f"{prefix}_year": F.year(date),
        f"{prefix}_month": F.month(date),
        f"{prefix}_day": F.dayofmonth(date),
    })


def concat_fill(df: DataFrame, out: str, first: str, *rest: str, sep: str = " ") -> DataFrame:
    """Join columns into ``out``; null only where ``first`` is."""
    return df.withColumn(out, C.concat_fill(F.col(first), *map(F.col, rest), sep=sep))


def concat_skip_nulls(df: DataFrame, out: str, *names: str, sep: str = " ") -> DataFrame:
    """Join the values that are there into ``out``."""
    return df.withColumn(out, C.concat_skip_nulls(*map(F.col, names), sep=sep))


def default_fill_cast(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """``{column: (type, default)}``: re-type, default where missing."""
    return df.withColumns({
        name: C.default_fill_cast(F.col(name), dtype, default)
        for name, (dtype, default) in defaults.items()
    })


def sentinel_to_null(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sentinels: Sequence[str] = tuple(SENTINELS),
) -> DataFrame:
    """Null where a text stands for "missing", in all text columns or the given ones."""
    names = _string_columns(df) if columns is None else columns
    return df.withColumns({name: C.sentinel_to_null(F.col(name), sentinels) for name in names})


def scrub_newlines(df: DataFrame) -> DataFrame:
    """Line breaks become blanks in every text column."""
    return df.withColumns({name: C.scrub_newlines(F.col(name)) for name in _string_columns(df)})


def flatten_struct_array(
    df: DataFrame,
    fields: Mapping[str, str],
    sep: str = ", ",
    sentinels: Sequence[str] = tuple(SENTINELS),
) -> DataFrame:
    """``{column: field}``: array of structs to one text of joined names, null when none is left."""
    return df.withColumns({
        name: C.joined_names(F.col(name), field, sep, sentinels) for name, field in fields.items()
    })


def json_names_to_string(
    df: DataFrame, column: str, schema: T.StructType, array: str, field: str = "name", sep: str = ", "
) -> DataFrame:
    """JSON text holding an array of named objects to one text of joined names."""
    return df.withColumn(column, C.names_from_json(F.col(column), schema, array, field, sep))


def exploded(df: DataFrame, keep: Sequence[str], array: Column, out: str) -> DataFrame:
    """One row per element of ``array`` that is there, with the columns ``keep``.

    An inner ``explode`` would make the optimizer put a filter on the array's size below it, and so
    compute a costly array twice; the outer form with a filter above does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(out)).filter(F.col(out).isNotNull())
