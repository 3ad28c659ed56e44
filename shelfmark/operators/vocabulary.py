"""The most frequent words of a corpus, by bounded summaries of each task and an exact second count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import scratch_path

# Words a vocabulary may have to be ranked in one task and broadcast.
MAX_VOCABULARY = 100_000
COUNTERS = 1 << 16  # words a task passes on, at least
BATCH_ROWS = 2000  # rows that Python gets at once; their arrays of words are long
_PLACE_BITS = 33  # bits for the place in a task in Spark's row numbers
_SUMMARY = "word string, count long, doc_freq long, missed long"


def _summary(counters: int) -> Callable:
    """A function from a task's rows of words and their counts to at most ``counters`` words, and one row without a word.

    Words are added up; when more than twice ``counters`` are held the rarest go. ``missed`` of the row without a word is the sum of the
    highest counts that went, so no word occurs in the task more than that beyond what is passed on for it. It carries all
    it needs with it, so workers do not need this package.
    """

    def summary(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["word", "count", "doc_freq"]
        held = pa.table({"word": pa.array([], pa.large_string()), "count": pa.array([], pa.int64()), "doc_freq": pa.array([], pa.int64())})
        missed = 0

        def added(tables):
            total = pa.concat_tables(tables).group_by("word").aggregate([("count", "sum"), ("doc_freq", "sum")])
            return total.select(["word", "count_sum", "doc_freq_sum"]).rename_columns(names)

        def cut(table):
            order = pc.sort_indices(table, sort_keys=[("count", "descending")])
            return table.take(order.slice(0, counters)), table["count"][order[counters].as_py()].as_py()

        waiting, size = [], 0
        for batch in batches:
            words = pc.list_flatten(batch.column(0)).cast(pa.large_string())
            ones = pa.array([1]).take(pa.repeat(0, len(words)))
            counts = pc.list_flatten(batch.column(1)) if batch.num_columns > 1 else ones
            part = added([pa.table({"word": words, "count": counts, "doc_freq": ones}).filter(pc.is_valid(words))])
            waiting.append(part)
            size += len(part)
            if size > counters:
                held, waiting, size = added([held, *waiting]), [], 0
                if len(held) > 2 * counters:
                    held, most = cut(held)
                    missed += most
        held = added([held, *waiting])
        if len(held) > counters:
            held, most = cut(held)
            missed += most
        for part in held.combine_chunks().to_batches(max_chunksize=1 << 14):
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), part.column(2), none], names=[*names, "missed"])
        if missed:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([missed])], names=[*names, "missed"])

    return summary


def most_frequent(df: DataFrame, words: Column, counts: Column | None, size: int, counters: int | None = None) -> DataFrame:
    """``(word, count, doc_freq)`` of the ``size`` most frequent words, exactly; ties go to the smaller word (runs jobs).

    ``words`` is an array a row and ``counts``, of the same length, how often each occurs, once where it is None; ``doc_freq`` counts entries. Nulls
    are left out. Each task passes on at most ``counters`` words (by default ``COUNTERS``, or four times ``size`` if that is more),
    written to the scratch folder. Where no task left a word out, their sums are the counts. Else a word's count is at most its sum and all that
    tasks may have missed; only words that can so reach the sum of the word in place ``size`` are counted again. Where
    what was missed is as much as that sum, all words are counted.
    """
    if size <= 0:
        raise ValueError("a vocabulary has at least one word")
    spark = df.sparkSession
    entries = df.select(words.alias("w"), *([] if counts is None else [counts.alias("n")]))
    path = scratch_path(spark, "words")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    entries.filter("w IS NOT NULL").mapInArrow(_summary(counters or max(COUNTERS, 4 * size)), _SUMMARY).write.parquet(path)
    summaries = spark.read.schema(_SUMMARY).parquet(path)
    totals = summaries.filter("word IS NOT NULL").groupBy("word").agg(F.sum("count").alias("count"), F.sum("doc_freq").alias("doc_freq"))
    missed = summaries.agg(F.coalesce(F.sum("missed"), F.lit(0))).first()[0]
    if not missed:
        return _first(totals, size)
    # Outer, with a filter, for the reason given at ``exploded``.
    pairs = F.arrays_zip("w", F.col("w") if counts is None else F.col("n"))
    flat = entries.select(F.inline_outer(pairs)).toDF("word", "n").filter("word IS NOT NULL")
    lowest = _first(totals, size).agg(F.count("word").alias("words"), F.min("count").alias("count")).first()
    if lowest["words"] == size and lowest["count"] > missed:
        kept = scratch_path(spark, "candidates")
        totals.filter(F.col("count") + missed >= lowest["count"]).select("word").write.parquet(kept)
        flat = flat.join(spark.read.schema("word string").parquet(kept), "word", "left_semi")
    n = F.lit(1) if counts is None else F.col("n")
    exact = flat.groupBy("word").agg(F.sum(n).cast("long").alias("count"), F.count(F.lit(1)).alias("doc_freq"))
    return _first(exact, size)


def _first(counted: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows by count and word; a large number is not brought into one task.

    Then rows are sorted by ranges and written with their task and place in it, and the numbers of rows per task tell where to cut.
    """
    ordered = counted.orderBy(F.desc("count"), "word")
    if size <= MAX_VOCABULARY:
        return ordered.limit(size)
    spark = counted.sparkSession
    path = scratch_path(spark, "ranked")
    ordered.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    ranked = spark.read.schema(f"{counted.schema.simpleString()[7:-1].replace(':', ' ')}, _place long").parquet(path)
    part, within = F.shiftright("_place", _PLACE_BITS), F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    left = size
    for task, rows in sorted(tuple(r) for r in ranked.groupBy(part.alias("part")).count().collect()):
        if rows > left:
            return ranked.filter((part < task) | ((part == task) & (within < left))).drop("_place")
        left -= rows
    return ranked.drop("_place")
