"""Sums that no single task has to hold: arrays merged slice by slice, and running sums within keys of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import small_batches, stored

SLICE_BYTES = 1 << 18
PARTS = "name string, slice int, task int, data binary"


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def sliced(name: str, array: np.ndarray, dtype: str | None = None) -> Iterator[pa.RecordBatch]:
    """A task's array as rows ``PARTS``, with numbers of type ``dtype``; slices of zeros are left out."""
    dtype = np.dtype(dtype or array.dtype)
    width = SLICE_BYTES // dtype.itemsize
    for k in range(0, len(array), width):
        part = array[k:k + width]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([k // width], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pack(part.astype(dtype))], pa.binary())],
                ["name", "slice", "task", "data"])


def merged(parts: DataFrame, dtype: str, combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> DataFrame:
    """``(name, slice, task, data)``: rows ``PARTS`` of all tasks combined to one for each slice.

    Two rounds, each over the root of the number of tasks, so no task reads the parts of all. Rows arrive sorted, and one
    slice at a time is held.
    """
    tasks = parts.agg(F.max("task")).first()[0] or 0
    group = isqrt(tasks) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            names, slices, tasks = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for i, now in enumerate(zip(names, slices, tasks)):
                part = unpack(batch.column(3)[i].as_py(), dtype)
                if now == at:
                    total = combine(total, part)
                    continue
                if at is not None:
                    yield row(at, total)
                at, total = now, part
        if at is not None:
            yield row(at, total)

    def row(at: tuple, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([at[2]], pa.int32()), pa.array([pack(total)], pa.binary())], ["name", "slice", "task", "data"])

    for rest in (F.col("task") % group, F.lit(0)):
        dealt = parts.withColumn("task", rest.cast("int")).repartition("name", "slice", "task")
        parts = dealt.sortWithinPartitions("name", "slice", "task").mapInArrow(add, PARTS)
    return parts


def gathered(parts: DataFrame, dtype: str, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """The arrays of given sizes from their slices, on the driver."""
    arrays = {name: np.zeros(size, dtype) for name, size in sizes.items()}
    width = SLICE_BYTES // np.dtype(dtype).itemsize
    for r in parts.toLocalIterator():
        part = unpack(r["data"], dtype)
        arrays[r["name"]][r["slice"] * width:r["slice"] * width + len(part)] = part
    return arrays


def running(df: DataFrame, key: str, order: list[Column], sums: list[str], xors: list[str], label: str) -> DataFrame:
    """``df`` with each column of ``sums`` (or ``xors``) replaced by its sum (exclusive or) over the rows of the same key up to this
    one, and ``_part``, a number that ascends with key and order. All these columns are long, without nulls; so is the key.

    Rows are dealt by key, order and row number, so a key of any size spreads over many tasks; each task sums its own rows, and
    what a key brings along from the tasks before is added afterwards. The driver gets one row per task.
    """
    columns = df.columns
    sort = [F.col(key).asc(), *order, F.col("_row")]
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).select(*columns)
    names = [*columns, "_part", "_at"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _part int, _at long"
    small_batches(df.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), 0, None
        carry = dict.fromkeys([*sums, *xors], 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(columns.index(key)).to_numpy()
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            of = np.repeat(start, np.diff(np.append(start, n)))
            out = dict(zip(columns, batch.columns))
            for c in carry:
                v = out[c].to_numpy()
                acc = np.cumsum(v) if c in sums else np.bitwise_xor.accumulate(v)
                before = np.append(np.int64(0), acc)[of]
                acc = acc - before if c in sums else acc ^ before
                if keys[0] == last:
                    first = of == 0
                    acc[first] = acc[first] + carry[c] if c in sums else acc[first] ^ carry[c]
                carry[c] = acc[-1]
                out[c] = pa.array(acc)
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], names)
            at += n

    local = stored(dealt.mapInArrow(add, schema), label)
    ends = local.groupBy("_part").agg(
        F.min_by(key, "_at").alias("first"), F.max_by(F.struct(F.col(key).alias("key"), *sums, *xors), "_at").alias("end"))
    carried, last, total = [], None, {}
    for r in sorted(ends.collect()):
        brought = total if r["first"] == last else dict.fromkeys([*sums, *xors], 0)
        carried.append((r["_part"], r["first"], *(brought[c] for c in (*sums, *xors))))
        end = r["end"]
        own = brought if end["key"] == r["first"] else dict.fromkeys(brought, 0)
        last, total = end["key"], {c: end[c] + own[c] if c in sums else end[c] ^ own[c] for c in brought}
    if not carried:
        return local.drop("_at")
    more = df.sparkSession.createDataFrame(carried, "_part int, _first long, " + ", ".join(f"_c_{c} long" for c in (*sums, *xors)))
    with_carry = local.join(F.broadcast(more), "_part")
    brought = {c: F.when(F.col(key) == F.col("_first"), F.col(f"_c_{c}")).otherwise(F.lit(0)) for c in (*sums, *xors)}
    return with_carry.select(*(
        (F.col(c) + brought[c]).alias(c) if c in sums else F.col(c).bitwiseXOR(brought[c]).alias(c) if c in xors else F.col(c) for c in columns), "_part")
