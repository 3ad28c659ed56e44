"""Best-fit packing of token sequences by large-item matching.

Where a piece goes depends on its length only, so the plan is made on the counts of lengths, of which there are at
most ``capacity``, and is as good as one made on all pieces at once:

* Pieces above a third of the capacity go at most two to a sequence. From the longest down, each length
  is matched with the longest still there that fits beside it.
* Smaller pieces, longest first, go into the sequence with the least sufficient gap.

Equal steps are taken together: a step of the plan says that pieces number ``low`` to ``high`` of a length fill,
``each`` to a sequence, a run of sequences from a given offset on. The plan's size depends on the capacity alone.
Pieces are numbered within their length by task, from counts per task and length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored
from shelfmark.llm.encoding import encoder


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps ``(length, low, high, first_sequence, each, offset)`` for ``counts`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    done: Counter[int] = Counter()
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps: list[int] = []
    sequences = 0

    def place(n: int, pieces: int, first: int, each: int, offset: int) -> None:
        steps.append((n, done[n], done[n] + pieces, first, each, offset))
        done[n] += pieces
        left[n] -= pieces

    def leave(gap: int, low: int, high: int) -> None:
        if gap > 0 and high > low:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((low, high))

    large = sorted(n for n in left if 3 * n > capacity)
    small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
    while large:
        a = large[-1]
        at = bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] == 1:
            b = large[at - 1] if at > 0 else None
        runs = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        place(a, runs, sequences, 1, 0)
        if b is not None:
            place(b, runs, sequences, 1, a)
        leave(capacity - a - (b or 0), sequences, sequences + runs)
        sequences += runs
        large = [n for n in large if left[n]]
    for n in small:
        while left[n]:
            at = bisect_left(open_gaps, n)
            if at == len(open_gaps):
                gap, low, high = capacity, sequences, sequences + -(-left[n] // (capacity // n))
                sequences = high
            else:
                gap = open_gaps[at]
                low, high = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            each = gap // n
            runs = min(high - low, left[n] // each)
            if not runs:
                each, runs = left[n], 1
            place(n, runs * each, low, each, capacity - gap)
            leave(gap - each * n, low, low + runs)
            leave(gap, low + runs, high)
    return steps


def token_pieces(docs: DataFrame, key: str, text: str, path: str, end_id: int, capacity: int, special: bool = False) -> DataFrame:
    """``(key, piece, start, length, ids, part, number)``: each text's ids and ``end_id``, cut only if longer than ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers; ``number`` counts the pieces of one length in one task (``part``).
    """
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part = encoder(path, special), Counter(), TaskContext.get().partitionId()
        out: list[tuple] = []
        held = 0

        def flush(keys):
            at, *columns = zip(*out)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), *arrays[:4], pa.array([part] * len(at), pa.int32()), arrays[4]], names)

        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                ids = enc.encode(value.as_py() or "") + end
                for piece, a in enumerate(range(0, len(ids), width)):
                    own = ids[a:a + width]
                    n = len(own) // 4
                    out.append((i, piece, a // 4, n, own, seen[n]))
                    seen[n] += 1
                    held += len(own)
                if held > 1 << 22:
                    yield flush(batch.column(0))
                    out, held = [], 0
            if out:
                yield flush(batch.column(0))
                out, held = [], 0

    names = [key, "piece", "start", "length", "ids", "part", "number"]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(make, f"{key} {kind}, piece int, start long, length long, ids binary, part int, number long")


def best_fit_pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces as ``token_pieces`` gives them (written, so that numbers hold).

    Only counts per task and length are shuffled, and the pieces' columns other than ``ids`` if those are left out
    of ``pieces``. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = spark.createDataFrame(packing_plan(lengths, capacity), "p_length long, low long, high long, first long, each long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("number"))
    # The plan's number of steps is bounded by the capacity, whatever the number of pieces.
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    )
    nth = F.col("rank") - F.col("low")
    return placed.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("each"))).withColumn(
        "offset", F.col("at") + (nth % F.col("each")) * F.col("length")
    ).drop("base", "rank", "p_length", "low", "high", "first", "each", "at")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the pieces of each sequence joined, at most ``capacity`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.concat(F.lit(b"")).alias("_e"), parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"])).alias("ids")
    )


def pack_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0, capacity: int = 2048, special: bool = False
) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every row.

    A null text is an empty one and has the end id only. ``special`` is that of ``Encoder``. Rows with equal or null keys are packed each for
    itself. Further columns are ignored.
    """
    pieces = stored(token_pieces(docs, key, text, path, end_id, capacity, special), "pieces")
    slim = pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "number")
    return best_fit_pack(slim, capacity).drop("part", "number")
