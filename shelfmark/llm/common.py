"""What the operators share: written intermediate tables, Arrow batches, and sums of fixed-size arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import scratch_path

SLICE = 1 << 16  # numbers of an array that travel together
BATCH_ROWS = 2000  # rows that Python gets at once; texts are long


_KEPT: dict = {}


def kept(name: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once per Python worker and kept from task to task."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def forget_kept() -> None:
    """Free what earlier tasks of this Python worker kept; for tasks of other work, since workers live on."""
    _KEPT.clear()


def small_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches on the session, which bounds the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read again: a cut in the lineage that
    survives the loss of executors, and a side of a join that adaptive execution can split. Columns ``by``, the last ones, become folders."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with ``f`` giving columns (by name) for each batch of rows."""
    small_batches(df.sparkSession)
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in f(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[c]) if not isinstance(columns[c], pa.Array)
                                                  else columns[c] for c in names], names)

    return df.mapInArrow(run, schema)


def sum_arrays(partials: DataFrame, key: str, size: int, combine: np.ufunc = np.add) -> dict:
    """Sums, per value of ``key``, of the arrays of ``size`` numbers given as rows ``(key, slice, salt, counts)``.

    ``counts`` is packed as ``slices`` does it; ``combine`` may be another operation than addition. It is done in two rounds,
    first per salt, so that no task gets the parts of all tasks. Only the sums, of fixed size, reach the driver.
    """
    small_batches(partials.sparkSession)
    schema = f"{key} string, slice int, salt int, counts binary"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _unpack(pdf["counts"].iloc[0]).copy()
        for part in pdf["counts"].iloc[1:]:
            combine(total, _unpack(part), out=total)
        return pdf.iloc[:1].assign(counts=[_pack(total)])

    rows = partials.select(F.col(key).cast("string").alias(key), "slice", "salt", "counts")
    once = rows.groupBy(key, "slice", "salt").applyInPandas(add, schema)
    twice = once.groupBy(key, "slice").applyInPandas(add, schema)
    sums: dict = {}
    for row in twice.toLocalIterator():
        array = sums.setdefault(row[key], np.zeros(size, dtype=np.int64))
        part = _unpack(row["counts"])
        array[row["slice"] * SLICE:row["slice"] * SLICE + len(part)] = part
    return sums


def _pack(part: np.ndarray) -> bytes:
    """Little-endian int64, compressed: most counts of a task are small or zero."""
    return zstandard.ZstdCompressor(level=1).compress(part.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<i8")


def slices(array: np.ndarray, salt: int) -> list[tuple[int, int, bytes]]:
    """The rows ``(slice, salt, counts)`` that ``sum_arrays`` takes; slices of zeros are left out."""
    rows = []
    for k in range(0, len(array), SLICE):
        part = array[k:k + SLICE].astype("<i8")
        if part.any():
            rows.append((k // SLICE, salt % 32, _pack(part)))
    return rows
