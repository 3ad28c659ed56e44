"""Counts, profiles, correlations, vector means."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.columns import floor_bucket
from shelfmark.operators.comoments import comoments
from shelfmark.operators.filters import filter_min
from shelfmark.operators.project import exploded

# Bands of the correlation report, as (name, lowest, upper bound). Positive and
# negative bands both contain their lower and not their upper bound, except that 1 is strong.
CORRELATION_BANDS = [
    ("Strong Positive", 0.7, 1.0),
    ("Moderate Positive", 0.5, 0.7),
    ("Weak Positive", 0.3, 0.5),
    ("Strong Negative", -1.0, -0.7),
    ("Moderate Negative", -0.7, -0.5),
    ("Weak Negative", -0.5, -0.3),
]


def count_by(df: DataFrame, keys: Sequence[str], count: str = "count") -> DataFrame:
    """Rows per key, most frequent first."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), *keys)
    )


def rating_distribution(
    df: DataFrame, votes: str, score: str, min_votes: int, bucket: str = "rating_group"
) -> DataFrame:
    """Rows per whole score among those with enough votes, highest score first."""
    rated = filter_min(df, votes, min_votes).select(floor_bucket(F.col(score)).alias(bucket))
    return rated.groupBy(bucket).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc(bucket))


def _as_rows(row: DataFrame, structs: list[Column]) -> DataFrame:
    """One wide row as one row per struct."""
    return row.select(F.inline(F.array(*structs)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Filled and missing values per column, all columns in one pass."""
    names = list(columns or df.columns)
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count(F.col(name)).alias(f"_n{i}") for i, name in enumerate(names)),
    )
    return _as_rows(totals, [
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"_n{i}").alias("non_null"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("nulls"),
        )
        for i, name in enumerate(names)
    ])


@dataclass
class ObservedProfile:
    """A null profile that the job over the rows itself fills in."""

    columns: list[str]
    counts: Observation

    def rows(self, spark: SparkSession) -> DataFrame:
        """``null_profile`` of the rows that went through; to be called after that job."""
        found = self.counts.get
        made = [(c, found[f"n{i}"], found["rows"] - found[f"n{i}"]) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(made, "column string, non_null long, nulls long")


def observed_profile(df: DataFrame, empty_is_null: bool = False) -> tuple[DataFrame, ObservedProfile]:
    """``df``, and its null profile, counted as observed metrics while another job reads or writes it: no scan of its own.

    With ``empty_is_null`` an empty text counts as missing, as in a file that cannot tell them apart. A task that runs
    again after a lost executor can be counted twice; ``null_profile`` is exact in any case.
    """
    profile = ObservedProfile(df.columns, Observation())
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)} if empty_is_null else set()
    filled = [F.when(F.col(c) != "", F.col(c)) if c in texts else F.col(c) for c in df.columns]
    counts = [F.count(v).alias(f"n{i}") for i, v in enumerate(filled)]
    return df.observe(profile.counts, F.count(F.lit(1)).alias("rows"), *counts), profile


def nonconstant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns whose sample standard deviation is there and positive."""
    totals = df.agg(*(F.stddev_samp(F.col(c)).alias(f"_s{i}") for i, c in enumerate(columns)))
    rows = _as_rows(totals, [
        F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("stddev"))
        for i, c in enumerate(columns)
    ])
    return rows.filter(F.col("stddev") > 0)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix of the non-constant columns as rows ``(a, b, r)`` (runs one job).

    A pair uses the rows that have both values; nulls, NaN and infinite values are missing. A constant column
    drops out, as does a pair that is constant where both are there. The result stays distributed.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    pairs = comoments(df, columns).filter(F.col("varies") & (F.col("m_aa") > 0) & (F.col("m_bb") > 0))
    r = F.col("m_ab") / F.col("m_aa") * F.sqrt(F.col("m_aa") / F.col("m_bb"))  # no product of squares, which could overflow
    r = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
    name = lambda place: F.get(F.array(*map(F.lit, columns)), F.col(place))
    named = pairs.select(name("a").alias("a"), name("b").alias("b"), r.alias("r"), (F.col("a") < F.col("b")).alias("two"))
    mirrored = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    once = F.array(F.struct("a", "b", "r"))
    return named.select(F.inline(F.when(F.col("two"), F.concat(once, F.array(mirrored))).otherwise(once)))


def correlation_bands(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each pair of columns once, with the band its correlation falls in; weaker pairs drop out.

    ``columns`` gives the order of a pair, as in the matrix.
    """
    names = F.array(*map(F.lit, columns))
    upper = matrix.filter(F.array_position(names, F.col("a")) < F.array_position(names, F.col("b")))
    band = F.when(F.col("r") == 1.0, CORRELATION_BANDS[0][0])
    for name, low, high in CORRELATION_BANDS:
        band = band.when((F.col("r") >= low) & (F.col("r") < high), name)
    return upper.withColumn("band", band).filter(F.col("band").isNotNull())


def word_counts(df: DataFrame, words: str, word: str = "word", count: str = "count") -> DataFrame:
    """How often each word of an array column occurs, most frequent first."""
    return count_by(exploded(df, [], F.col(words), word), [word], count)


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """Rows per cluster, largest first."""
    return count_by(df, [cluster])


def avg_bucket_per_cluster(df: DataFrame, cluster: str, bucket: str) -> DataFrame:
    """Average bucket per cluster, highest first."""
    out = f"avg_{bucket}"
    return df.groupBy(cluster).agg(F.avg(bucket).alias(out)).orderBy(F.desc(out), cluster)


def tag_counts_per_cluster(
    df: DataFrame, cluster: str, tags: str, tag: str = "tag", sep: str = ","
) -> DataFrame:
    """Rows per (cluster, tag) of a separated text column; blank tags drop out."""
    rows = exploded(df, [cluster], F.split(F.col(tags), sep), tag)
    trimmed = rows.withColumn(tag, F.trim(tag)).filter(F.col(tag) != "")
    return trimmed.groupBy(cluster, tag).agg(F.count(F.lit(1)).alias("count"))


# Groups of tasks whose partial vector sums are merged before the final merge.
MERGE_SLICES = 256


def mean_vector(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean per dimension, over all rows or per ``by``, as rows ``(.., dim, mean)``.

    Vectors are summed as vectors; only one mean vector per group is exploded into dimensions.
    Every task ends with one vector per group, and those are merged in two rounds, so that no single
    task reads the vectors of all others, however few groups there are.
    """
    slices = F.pmod(F.spark_partition_id(), F.lit(MERGE_SLICES)).alias("_slice")
    partial = (
        df.filter(F.col(vector).isNotNull())
        .select(*by, slices, array_to_vector(F.col(vector)).alias("_v"))
        .groupBy(*by, "_slice")
        .agg(Summarizer.mean(F.col("_v")).alias("_v"), F.count(F.lit(1)).cast("double").alias("_n"))
    )
    # By a constant where there is no key: no row then, and not an empty mean, for an empty table.
    means = partial.groupBy(*(by or [F.lit("all")])).agg(
        vector_to_array(Summarizer.mean(F.col("_v"), F.col("_n"))).alias("_mean")
    )
    return means.select(*by, F.posexplode("_mean").alias("dim", "mean"))
