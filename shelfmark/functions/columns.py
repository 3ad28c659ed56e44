"""Scalar column expressions: cleaning, casting, joining of texts, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.schema import SENTINELS

# Characters not allowed in a title that becomes part of a path.
TITLE_CHARS = '\\/*?:"<>|'


def strip_chars(col: Column, chars: str) -> Column:
    """Delete every character of ``chars``."""
    return F.translate(col, chars, "")


def floor_bucket(col: Column) -> Column:
    """Bucket a score by its whole part."""
    return F.floor(col).cast("bigint")


def prefix_path(col: Column, base: str) -> Column:
    """Put a constant in front of a path; null stays null."""
    return F.concat(F.lit(base), col)


def concat_fill(first: Column, *rest: Column, sep: str = " ") -> Column:
    """``first`` and ``rest`` joined; missing ``rest`` count as empty, a missing ``first`` gives null."""
    parts = [first]
    for col in rest:
        parts += [F.lit(sep), F.coalesce(col, F.lit(""))]
    return F.concat(*parts)


def concat_skip_nulls(*cols: Column, sep: str = " ") -> Column:
    """Join the values that are there; never null."""
    return F.concat_ws(sep, *cols)


def sentinel_to_null(col: Column, sentinels: Sequence[str] = tuple(SENTINELS)) -> Column:
    """Null when the text, without outer blanks, is one of ``sentinels``."""
    return F.when(~F.trim(col).isin(*sentinels), col)


def scrub_newlines(col: Column) -> Column:
    """Line breaks become blanks."""
    return F.translate(col, "\n\r", "  ")


def default_fill_cast(col: Column, dtype: str, default) -> Column:
    """Re-type ``col``; missing and unreadable values become ``default``."""
    return F.coalesce(col.try_cast(dtype), F.lit(default).cast(dtype))


def parsed_date(col: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Date of a text, null where it is none."""
    return F.try_to_date(col, fmt)


def struct_names(col: Column, field: str, sentinels: Sequence[str] = tuple(SENTINELS)) -> Column:
    """One field of an array of structs as an array of texts, missing ones left out."""
    names = F.transform(col, lambda item: item[field])
    return F.filter(names, lambda name: name.isNotNull() & ~F.trim(name).isin(*sentinels))


def joined_names(
    col: Column, field: str, sep: str = ", ", sentinels: Sequence[str] = tuple(SENTINELS)
) -> Column:
    """``struct_names`` as one text, null when nothing is left."""
    names = struct_names(col, field, sentinels)
    return F.when(F.size(names) > 0, F.array_join(names, sep))


def names_from_json(
    col: Column, schema: T.StructType, array: str, field: str, sep: str = ", "
) -> Column:
    """Names held in a JSON text ``{array: [{field: ..}, ..]}`` as one text; no names gives null."""
    names = F.transform(F.from_json(col, schema)[array], lambda item: item[field])
    return F.when(F.size(names) > 0, F.array_join(names, sep))
