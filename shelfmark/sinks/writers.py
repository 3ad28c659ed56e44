"""Writers; each runs one job and gives back the path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.rank import sort_by_score
from shelfmark.schema import ROWS_PER_FILE
from shelfmark.session import scratch_path
from shelfmark.sinks.folders import delete, move, names

NULL_MARK = "NA"
CHUNK = "chunk"
MOST_TASKS = 100_000  # tasks that write chunks; beyond that a task writes several
_TASK_BITS = 33  # bits for the place in a task in Spark's row numbers


def _csv(df: DataFrame, mode: str):
    return df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')


def write_csv_chunked(
    df: DataFrame, path: str, chunk_size: int = ROWS_PER_FILE, null_value: str = NULL_MARK, mode: str = "error", base: str | None = None
) -> str:
    """CSV files of exactly ``chunk_size`` rows each, but for the last, in numbered folders ``chunk=1``, ``chunk=2``, ..

    Rows keep their order. They are written once as parquet, with their task and place in it; the rows per task (one number each) are
    summed up on the driver, which gives every row its number and so its chunk; each chunk is then written by one task. With ``base`` the files
    are moved to ``<base>_1.csv``, ``<base>_2.csv``, .. in ``path``, one move per file by the driver. ``chunk`` must not be a column.
    """
    if CHUNK in df.columns:
        raise ValueError(f"{CHUNK} is the name of the folders")
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    staged_path = scratch_path(spark, "chunks")
    df.select("*", place.alias("_place")).write.parquet(staged_path)
    staged = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_place", T.LongType())])).parquet(staged_path)
    part, within = F.shiftright("_place", _TASK_BITS), F.col("_place").bitwiseAND(F.lit((1 << _TASK_BITS) - 1))
    sizes = sorted(tuple(r) for r in staged.groupBy(part.cast("int").alias("part")).count().collect())
    starts, rows = [], 0
    for task, size in sizes:
        starts.append((task, rows))
        rows += size
    chunks = -(-rows // chunk_size)
    if not rows:
        _csv(df.limit(0), mode).option("nullValue", null_value).csv(path)
        return path
    before = F.broadcast(spark.createDataFrame(starts, "_task int, _before long"))
    number = F.floor((F.col("_before") + within) / F.lit(chunk_size)) + 1
    numbered = staged.withColumn("_task", part.cast("int")).join(before, "_task").withColumn(CHUNK, number)
    dealt = numbered.repartitionByRange(min(chunks, MOST_TASKS), CHUNK).sortWithinPartitions(CHUNK, "_place").select(*df.columns, CHUNK)
    _csv(dealt, mode).option("nullValue", null_value).partitionBy(CHUNK).csv(path)
    delete(spark, staged_path)
    if base is not None:
        for n in range(1, chunks + 1):
            folder = f"{path}/{CHUNK}={n}"
            (name,) = (f for f in names(spark, folder) if f.startswith("part-"))
            move(spark, f"{folder}/{name}", f"{path}/{base}_{n}.csv")
            delete(spark, folder)
    return path


def write_csv_quoteall_sorted(
    df: DataFrame, path: str, score: str, tie: str, null_value: str = NULL_MARK, mode: str = "error"
) -> str:
    """CSV sorted by ``score``, highest first, with every field quoted.

    The order runs through the files by name; a missing value is written as ``null_value``, so that
    it differs from an empty text.
    """
    ordered = sort_by_score(df, score, tie)
    _csv(ordered, mode).option("quoteAll", True).option("nullValue", null_value).csv(path)
    return path


def write_result_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "error") -> str:
    """A result table as CSV with header.

    ``single_file`` is for results bounded by construction, such as a top-k report; it moves the
    finished rows, not the work before them, into one task.
    """
    _csv(df.repartition(1) if single_file else df, mode).csv(path)
    return path


def write_ndjson(df: DataFrame, path: str, mode: str = "append") -> str:
    """One JSON record per line, appended by default; missing fields are written as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def write_features_parquet(df: DataFrame, path: str, mode: str = "error") -> str:
    """Vectors as one array column."""
    df.write.mode(mode).parquet(path)
    return path
