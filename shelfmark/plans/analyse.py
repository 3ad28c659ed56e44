"""The analysis job: rating, correlation, word and cluster reports over the cleaned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfmark.functions.columns import TITLE_CHARS
from shelfmark.operators import aggregate as A
from shelfmark.operators import rank as R
from shelfmark.operators.filters import filter_min
from shelfmark.operators.project import cast_numeric, concat_skip_nulls, floor_bucket, strip_chars
from shelfmark.operators.relate import embedding_or_zero, left_join_checked, left_join_unique, semi_join_available
from shelfmark.operators.text import frequent_words
from shelfmark.operators.principal import pca_project
from shelfmark.operators.vectors import gather_columns, kmeans_assign
from shelfmark.schema import (
    CLUSTER_SEED,
    CLUSTERS,
    MIN_RATING_BUCKET,
    MIN_VOTES,
    RATING_COLUMNS,
    VOCABULARY_SIZE,
)
from shelfmark.sinks.writers import write_features_parquet, write_result_csv
from shelfmark.sources.readers import read_csv_multi, read_features_parquet


def prepare(df: DataFrame) -> DataFrame:
    """Re-type the numeric columns and drop characters that break later uses of the texts."""
    types = {
        "runtime": "double", "revenue": "double", "budget": "double",
        "release_year": "int", "release_month": "int",
    }
    return strip_chars(cast_numeric(df, types), {"overview": '"', "title": TITLE_CHARS})


def high_rated(df: DataFrame, min_votes: int = MIN_VOTES, min_bucket: int = MIN_RATING_BUCKET) -> DataFrame:
    """Rows with enough votes and a high whole score."""
    voted = filter_min(df, "vote_count", min_votes)
    return filter_min(floor_bucket(voted, "vote_average", "rating_group"), "rating_group", min_bucket)


def rating_reports(prepared: DataFrame, rated: DataFrame) -> dict[str, DataFrame]:
    """Distribution over all voted rows, correlations over the high rated ones."""
    matrix = A.correlation_matrix(rated, RATING_COLUMNS)
    return {
        "rating_distribution": A.rating_distribution(prepared, "vote_count", "vote_average", MIN_VOTES),
        "correlation_matrix": matrix,
        "correlation_bands": A.correlation_bands(matrix, RATING_COLUMNS),
    }


def word_report(rated: DataFrame, size: int = VOCABULARY_SIZE, stopwords: Sequence[str] | None = None) -> DataFrame:
    """Most frequent words of keywords and filtered text."""
    merged = concat_skip_nulls(rated, "merged_text", "keywords", "processed_text")
    return frequent_words(merged, "merged_text", size, stopwords)


def cluster_reports(
    clustered: DataFrame, rated: DataFrame, key: str = "id", vector: str = "embedding", title: str = "title"
) -> dict[str, DataFrame]:
    """Reports over rows that have ``key``, a vector and ``cluster``; items are named by key and title."""
    titles = rated.select(key, title)
    means = A.mean_vector(clustered, vector)
    cluster_means = A.mean_vector(clustered, vector, ["cluster"])
    meta = left_join_unique(
        clustered.select(key, "cluster"), rated.select(key, "rating_group", "genres"), key
    )
    tags = A.tag_counts_per_cluster(meta, "cluster", "genres", "genre")
    return {
        "cluster_sizes": A.cluster_sizes(clustered, "cluster"),
        "cluster_preview": left_join_unique(R.preview_rows(clustered, key, [key, "cluster"]), titles, key),
        "top_dims": R.top_dims(means),
        "top_items_on_top_dim": left_join_unique(R.top_items_on_top_dim(clustered, means, key, vector), titles, key),
        "top_dims_per_cluster": R.top_dims_per_cluster(cluster_means, "cluster"),
        "top_items_per_dim": left_join_unique(
            R.top_items_per_dim_per_cluster(clustered, cluster_means, key, vector, "cluster"), titles, key
        ),
        "avg_rating_per_cluster": A.avg_bucket_per_cluster(meta, "cluster", "rating_group"),
        "top_genres_per_cluster": R.top_tags_per_cluster(tags, "cluster", "genre"),
    }


def run_analysis(
    spark: SparkSession,
    cleaned_csv: str | list[str],
    vectors: str,
    out: str,
    key: str = "id",
    vector: str = "embedding",
    k: int = CLUSTERS,
    seed: int = CLUSTER_SEED,
    schema: T.StructType | None = None,
    wide_prefix: str | None = None,
    multi_line: bool = False,
    stopwords: Sequence[str] | None = None,
    zero_width: int | None = None,
) -> dict[str, str]:
    """All reports over the cleaned table and the stored vectors.

    The high rated rows and the clustered vectors feed several reports, so each is written once as
    parquet and read from there; a lost executor costs a re-read, not a re-run. ``schema`` saves the
    pass that infers the types of the CSV. ``stopwords`` are left out of the word report, by default those of the analyses. With
    ``zero_width`` a row without a vector gets a zero vector of that width; else it is in no cluster report. With ``wide_prefix`` the vectors are columns
    ``<prefix>0, <prefix>1, ..`` rather than one array column.
    """
    prepared = prepare(read_csv_multi(spark, cleaned_csv, schema, multi_line=multi_line, infer=True))
    high_rated(prepared).write.parquet(f"{out}/high_rated")
    rated = spark.read.parquet(f"{out}/high_rated")

    stored = read_features_parquet(spark, vectors)
    if wide_prefix is not None:
        stored = gather_columns(stored, key, wide_prefix, vector)
    if zero_width is None:
        features = semi_join_available(stored, rated, key)
    else:
        features = embedding_or_zero(rated.select(key), stored, key, vector, zero_width)
    write_features_parquet(kmeans_assign(features, vector, k, seed, key=key), f"{out}/clustered")
    clustered = spark.read.parquet(f"{out}/clustered")

    # The first job that joins by key checks that the rated rows have each key once.
    labelled, check = left_join_checked(clustered.select(key, "cluster"), rated.select(key, "title"), key)
    clusters = write_result_csv(labelled, f"{out}/clusters")
    check.verify()

    bounded = {
        **rating_reports(prepared, rated),
        "frequent_words": word_report(rated, stopwords=stopwords),
        **cluster_reports(clustered, rated, key, vector),
    }
    paths = {
        name: write_result_csv(report, f"{out}/{name}", single_file=True)
        for name, report in bounded.items()
    }
    paths["clusters"] = clusters
    paths["projection"] = write_result_csv(pca_project(clustered, key, vector), f"{out}/projection")
    return paths
