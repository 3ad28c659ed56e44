"""Joins and set operations.

No join here forces a broadcast: Spark broadcasts a side whose size it knows to be below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, and the adaptive skew rule splits
the partition of a hot key (or of null keys) by map-output blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfmark.operators.filters import drop_nulls_subset

# Rows a hinted broadcast may have at most; only for sides limited to a number of rows before.
MAX_BROADCAST_ROWS = 100_000


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when ``df`` is known to have at most ``max_rows`` rows and that is few."""
    return F.broadcast(df) if max_rows <= MAX_BROADCAST_ROWS else df


def _keys(df: DataFrame, key: str) -> DataFrame:
    """The keys that can match; a membership test does not need them distinct."""
    return drop_nulls_subset(df.select(key), [key])


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a key occurs twice (runs a job over the key columns)."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    if not repeated.isEmpty():
        raise ValueError(f"repeated keys in {', '.join(keys)}")


def left_join_unique(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join with cluster labels, or metadata by id.

    The caller says that ``other`` has each key once; ``assert_unique`` checks it in a job of its own, ``left_join_checked`` in the job
    that uses the result.
    """
    return df.join(other, on, "left")


@dataclass
class JoinCheck:
    """Rows before and after a join, counted by the job that computes all of its result."""

    before: Observation
    after: Observation

    def verify(self) -> int:
        """The number of rows of the result; raises when the join has multiplied rows. To be called after that job."""
        before, after = self.before.get["rows"], self.after.get["rows"]
        if before != after:
            raise ValueError(f"the join made {after} rows of {before}: a key is repeated")
        return after


def left_join_checked(df: DataFrame, other: DataFrame, on: str | list[str]) -> tuple[DataFrame, JoinCheck]:
    """``left_join_unique``, and the check that no row met two: ``check.verify()`` after the job that writes the result.

    Both counts are observed metrics of that job, which costs no further one and leaves the join as it is, with skewed keys
    split. A task that runs again after a lost executor can be counted twice; where the check then fails though the join is
    sound, ``assert_unique`` tells.
    """
    check = JoinCheck(Observation(), Observation())
    rows = F.count(F.lit(1)).alias("rows")
    return left_join_unique(df.observe(check.before, rows), other, on).observe(check.after, rows), check


def semi_join_vocab(df: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word is in the vocabulary."""
    return df.join(_keys(vocab, word), word, "left_semi")


def anti_join_stopwords(df: DataFrame, stopwords: Sequence[str], word: str = "word") -> DataFrame:
    """Rows whose word is not in the given list; rows without a word stay. The list is part of the filter: no join."""
    return df.filter(F.col(word).isNull() | ~F.col(word).isin(*stopwords))


def anti_join_pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to be worked on: those without an artefact in ``done``."""
    return df.join(_keys(done, key), key, "left_anti")


def semi_join_available(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have an artefact in ``done``."""
    return df.join(_keys(done, key), key, "left_semi")


def embedding_or_zero(
    df: DataFrame, vectors: DataFrame, key: str, vector: str, size: int
) -> DataFrame:
    """Each row with its vector, or a zero vector of ``size`` where there is none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    joined = left_join_unique(df, vectors.select(key, vector), key)
    return joined.withColumn(vector, F.coalesce(F.col(vector), zero))


def id_frontier(
    held: DataFrame, key: str, latest: int, done: DataFrame | None = None
) -> DataFrame:
    """Ids above the highest one held, up to and with ``latest``, less those already ``done``.

    The one number read to the driver is the highest id; the ids themselves are a distributed range.
    """
    highest = held.agg(F.max(key)).first()[0]
    first = 0 if highest is None else highest + 1
    ids = held.sparkSession.range(first, max(first, latest + 1)).withColumnRenamed("id", key)
    return ids if done is None else anti_join_pending(ids, done, key)


def held_intervals(held: DataFrame, key: str, block: int = 1 << 16) -> DataFrame:
    """The ids held as disjoint intervals ``(first, last)``, both ends included; ids without a gap between them are one interval.

    Gaps and islands in two steps: ids are joined to islands within blocks of ``block`` neighbouring ids, wherever many rows fall;
    islands that meet at a block's edge are then joined by a running count of those that do not, which needs two rows per block
    and not the ids.
    """
    ids = drop_nulls_subset(held.select(F.col(key).cast("long").alias("id")), ["id"]).distinct()
    of_block = F.floor(F.col("id") / F.lit(block))
    island = F.col("id") - F.row_number().over(Window.partitionBy("block").orderBy("id"))
    within = ids.withColumn("block", of_block).withColumn("island", island).groupBy("block", "island").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    low, high = F.col("block") * block, F.col("block") * block + (block - 1)
    at_edge = (F.col("first") == low) | (F.col("last") == high)
    inner = within.filter(~at_edge).select("first", "last")
    # At most two islands of a block reach its edges; these alone are put in one order.
    edges = within.filter(at_edge).select("first", "last")
    order = Window.orderBy("first")
    begins = F.when(F.col("first") == F.lag("last").over(order) + 1, 0).otherwise(1)
    joined = edges.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order)).groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return inner.unionByName(joined.select("first", "last"))


def missing_ids(held: DataFrame, key: str, lowest: int, latest: int, done: DataFrame | None = None, block: int = 1 << 16) -> DataFrame:
    """All ids from ``lowest`` to ``latest`` that are not held, below the highest one held as well as above it, less those ``done``.

    Found from the gaps, block by block of neighbouring ids: within a block between its held ids and its ends, and blocks without any held
    id as a whole. Nothing is put in one order, and held ids are not set against a list of all ids.
    """
    ids = drop_nulls_subset(held.select(F.col(key).cast("long").alias("id")), ["id"]).filter(F.col("id").between(lowest, latest)).distinct()
    inside = ids.withColumn("block", F.floor(F.col("id") / F.lit(block)))
    met = inside.select("block").distinct()
    ends = met.select(F.explode(F.array(F.col("block") * block - 1, (F.col("block") + 1) * block)).alias("id"), "block")
    after = F.lead("id").over(Window.partitionBy("block").orderBy("id"))
    gaps = inside.unionByName(ends).withColumn("next", after).filter(F.col("next") > F.col("id") + 1)
    gaps = gaps.select((F.col("id") + 1).alias("first"), (F.col("next") - 1).alias("last"))
    blocks = held.sparkSession.range(lowest // block, latest // block + 1).select(F.col("id").alias("block"))
    whole = blocks.join(met, "block", "left_anti").select((F.col("block") * block).alias("first"), ((F.col("block") + 1) * block - 1).alias("last"))
    clipped = gaps.unionByName(whole).select(F.greatest("first", F.lit(lowest)).alias("first"), F.least("last", F.lit(latest)).alias("last")).filter("first <= last")
    missing = clipped.select(F.explode(F.sequence("first", "last")).alias(key))
    return missing if done is None else anti_join_pending(missing, done, key)


def union_by_name(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns matched by name, missing ones null."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
