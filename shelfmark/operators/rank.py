"""Sorting, limits, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Slices of a group in the two-round form of ``top_per_group``.
TOP_SLICES = 4096


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "row_num"
) -> DataFrame:
    """The first ``k`` rows of each group with their position.

    Spark cuts each group to ``k`` rows per task before the shuffle, so a group holding most of the
    rows does not arrive whole in one task. It does so only up to its own limit on ``k``
    (``spark.sql.optimizer.windowGroupLimitThreshold``, 1000); above it the groups are cut in two
    rounds here, first among the rows of a group that come from the same input partition.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        # A partition number stays the same when a lost task runs again, and it spreads copies of
        # one row, which a hash of the row would not. At most TOP_SLICES x k rows of a group go on.
        sliced = Window.partitionBy(*group, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(TOP_SLICES)))
            .withColumn("_pos", F.row_number().over(sliced))
            .filter(F.col("_pos") <= k)
            .drop("_slice", "_pos")
        )
    ranked = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(ranked)).filter(F.col(rank) <= k)


def sort_by_score(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Total order, highest score first.

    ``tie`` belongs to the range bounds, so a score shared by a third of all rows is still spread
    over many partitions.
    """
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(tie))


def limit_sample(df: DataFrame, n: int, key: str, order: Column | None = None) -> DataFrame:
    """A repeatable sample of ``n`` rows: the first by a hash of ``key``, or by ``order``."""
    return df.orderBy(F.xxhash64(F.col(key)) if order is None else order, F.col(key)).limit(n)


def preview_rows(df: DataFrame, key: str, columns: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows by ``key``."""
    return df.orderBy(key).limit(n).select(*columns)


def top_tags_per_cluster(
    counts: DataFrame, cluster: str, tag: str, count: str = "count", k: int = 5
) -> DataFrame:
    """The most frequent tags of each cluster, ordered by cluster and count, both descending."""
    top = top_per_group(counts, [cluster], [F.desc(count), F.asc(tag)], k)
    return top.select(cluster, tag, count).orderBy(F.desc(cluster), F.desc(count), F.asc(tag))


def top_dims(means: DataFrame, k: int = 10) -> DataFrame:
    """The dimensions with the highest mean; ``means`` has ``dim`` and ``mean``."""
    return means.orderBy(F.desc("mean"), "dim").limit(k)


def top_items_on_top_dim(
    df: DataFrame, means: DataFrame, key: str, vector: str, k: int = 10
) -> DataFrame:
    """The items with the highest value on the single best dimension."""
    best = top_dims(means, 1).select("dim").scalar()
    scored = df.select(key, best.alias("dim"), vector)
    return (
        scored.select(key, "dim", F.get(F.col(vector), F.col("dim")).alias("value"))
        .orderBy(F.col("value").desc_nulls_last(), key)
        .limit(k)
    )


def top_dims_per_cluster(means: DataFrame, cluster: str, k: int = 5) -> DataFrame:
    """The best dimensions of each cluster; ``means`` has the cluster, ``dim`` and ``mean``."""
    top = top_per_group(means, [cluster], [F.desc("mean"), F.asc("dim")], k, rank="dim_rank")
    return top.select(cluster, "dim_rank", "dim", "mean")


def top_items_per_dim_per_cluster(
    df: DataFrame,
    means: DataFrame,
    key: str,
    vector: str,
    cluster: str,
    dims: int = 3,
    items: int = 3,
) -> DataFrame:
    """For the ``dims`` best dimensions of each cluster its ``items`` highest items.

    The best dimensions come as one short array per cluster, which Spark broadcasts while their size allows it;
    beyond that the join is shuffled, and a hot cluster is split. Only short rows go on to the ranking.
    """
    best = (
        top_dims_per_cluster(means, cluster, dims)
        .groupBy(cluster)
        .agg(F.sort_array(F.collect_list(F.struct("dim_rank", "dim", "mean"))).alias("best"))
    )
    values = df.join(best, cluster).select(
        key,
        cluster,
        F.inline_outer(F.transform(
            "best",
            lambda b: F.struct(
                b["dim_rank"].alias("dim_rank"),
                b["dim"].alias("dim"),
                b["mean"].alias("mean"),
                F.get(F.col(vector), b["dim"]).alias("value"),
            ),
        )),
    )
    order = [F.col("value").desc_nulls_last(), F.asc(key)]
    return top_per_group(values, [cluster, "dim_rank", "dim", "mean"], order, items, rank="item_rank")
