"""Readers for catalogues (CSV), raw records (NDJSON), vectors (parquet) and stopwords (text)."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.schema import CSV_NULL_TOKENS
from shelfmark.sinks.folders import files_below, first_line

Paths = str | list[str]
CORRUPT = "_corrupt"
_AT_ONCE = 16  # headers read at a time
_KINDS = ("int", "bigint", "double", "date", "timestamp", "boolean")  # narrower ones first


def _quoted_csv(spark: SparkSession, multi_line: bool):
    # A file with line breaks inside fields cannot be split, so one task reads each such file;
    # pass multi_line=False for large files known to be free of them.
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )


def _headers(new_reader, spark: SparkSession, paths: Paths) -> dict[tuple[str, ...], list[str]]:
    """The files of all paths by the names in their headers. Files are listed and their first lines read by the driver; empty files are left out."""
    files = [f for p in ([paths] if isinstance(paths, str) else paths) for f in files_below(spark, p)]
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines):
        if line is None:
            continue
        if line.count('"') % 2:  # a name with a line break
            header = tuple(new_reader().csv(file).columns)
        else:
            header = _safe_names(next(csv.reader([line.removeprefix("\ufeff")]), []))
        groups.setdefault(header, []).append(file)
    return groups


def _safe_names(header: list[str]) -> tuple[str, ...]:
    """A name for every column: a missing one is ``_c`` and its place, and a repeated one has its place after it."""
    low = Counter(n.lower() for n in header)
    return tuple(f"_c{i}" if not n else f"{n}{i}" if low[n.lower()] > 1 else n for i, n in enumerate(header))


def _by_name(new_reader, files: list[str], names: tuple[str, ...], schema: T.StructType | None) -> DataFrame:
    """Files of one header in one scan, as text, or picked by name and cast; a value that its type cannot hold is null."""
    read = new_reader().schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(files)
    if schema is None:
        return read
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{files[0]} lacks {', '.join(missing)}")
    return read.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields))


def _all_by_name(spark: SparkSession, new_reader, paths: Paths, schema: T.StructType | None) -> DataFrame:
    """One scan for each distinct header, put together by name. Without any header there are no rows."""
    parts = [_by_name(new_reader, files, names, schema) for names, files in sorted(_headers(new_reader, spark, paths).items())]
    if not parts:
        return spark.createDataFrame([], schema or T.StructType([]))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=schema is None)
    return first


def infer_types(texts: DataFrame) -> dict[str, str]:
    """The narrowest type that holds all values of each column of texts, by one aggregate over all rows.

    Types are ``int``, ``bigint`` and ``double``, each within the next, ``date`` within ``timestamp``, ``boolean``, and ``string``, which holds
    all; a column without values is ``string``. That every value is of a type is a bit per task and column, so parts of the
    rows can be judged apart and their bits put together.
    """
    judged = []
    for i, c in enumerate(texts.columns):
        v = F.col(f"`{c}`")
        whole = v.rlike(r"^[+-]?[0-9]+$")
        fits = {
            "int": whole & v.try_cast("int").isNotNull(),
            "bigint": whole & v.try_cast("bigint").isNotNull(),
            "double": v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
            "date": v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & v.try_cast("date").isNotNull(),
            "timestamp": v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$") & v.try_cast("timestamp").isNotNull(),
            "boolean": F.lower(v).isin("true", "false"),
        }
        judged += [F.bool_and(F.when(v.isNotNull(), fit)).alias(f"{i} {kind}") for kind, fit in fits.items()]
    if not judged:
        return {}
    found = texts.agg(*judged).first()
    return {c: next((kind for kind in _KINDS if found[f"{i} {kind}"]), "string") for i, c in enumerate(texts.columns)}


def read_catalog_csv(
    spark: SparkSession,
    paths: Paths,
    schema: T.StructType,
    null_tokens: Sequence[str] = tuple(CSV_NULL_TOKENS),
    multi_line: bool = True,
) -> DataFrame:
    """Headered CSV with a known schema, matched by name; every null token becomes null.

    Each of ``paths`` may have the columns in an order of its own, and further columns.
    """
    df = _all_by_name(spark, lambda: _quoted_csv(spark, multi_line), paths, schema)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*null_tokens), F.col(c)) for c in texts})


def read_csv_multi(
    spark: SparkSession,
    paths: Paths,
    schema: T.StructType | None = None,
    null_value: str = "NA",
    multi_line: bool = True,
    infer: bool = False,
) -> DataFrame:
    """Many headered CSV files as one table, matched by name.

    Without a schema all columns are text, or with ``infer`` of the types that one further pass over all files finds (``infer_types``); a
    file without one of the columns has nulls there. Files are scanned once for each distinct header, not one by one.
    """
    read = _all_by_name(spark, lambda: _quoted_csv(spark, multi_line).option("nullValue", null_value), paths, schema)
    if schema is not None or not infer:
        return read
    types = infer_types(read)
    return read.select(*(F.col(f"`{c}`").try_cast(kind).alias(c) if kind != "string" else F.col(f"`{c}`") for c, kind in types.items()))


def with_corrupt(schema: T.StructType) -> T.StructType:
    """``schema`` and a column for the text of unreadable records."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_ndjson(spark: SparkSession, paths: Paths, schema: T.StructType) -> DataFrame:
    """One JSON record per line; an unreadable line is kept in ``_corrupt``."""
    return (
        spark.read.schema(with_corrupt(schema))
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(paths)
    )


def read_features_parquet(spark: SparkSession, paths: Paths) -> DataFrame:
    """Stored vectors."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """Stopword lists as ``(lang, word)``, one word per line.

    The language is the name of the file, or of its ``lang=..`` folder.
    """
    lines = spark.read.text(path)
    lang = F.col("lang") if "lang" in lines.columns else F.col("_metadata.file_name")
    return lines.select(lang.alias("lang"), F.trim("value").alias("word")).filter(F.col("word") != "")


def stopword_list(spark: SparkSession, path: str, lang: str, most: int = 100_000) -> list[str]:
    """The words of one language's list, in order; raises when there are more than ``most`` or none."""
    words = read_stopwords(spark, path).filter(F.col("lang") == lang).select("word").distinct().limit(most + 1).collect()
    if not 0 < len(words) <= most:
        raise ValueError(f"the list for {lang} in {path} has {'too many' if words else 'no'} words")
    return sorted(r["word"] for r in words)
