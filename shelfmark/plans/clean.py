"""The cleaning job: catalogue to cleaned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.wordlists import ENGLISH_STOPWORDS
from shelfmark.operators.aggregate import observed_profile
from shelfmark.operators.dedup import dedup_keep_first
from shelfmark.operators.filters import drop_nulls_subset
from shelfmark.operators.project import concat_fill, date_parts, prefix_path, scrub_newlines
from shelfmark.operators.text import token_filter
from shelfmark.schema import CATALOG_SCHEMA, REQUIRED_COLUMNS, ROWS_PER_FILE
from shelfmark.sinks.writers import write_csv_chunked, write_result_csv
from shelfmark.sources.readers import read_catalog_csv


def clean_catalog(
    df: DataFrame,
    base_url: str,
    stopwords: Sequence[str] = tuple(ENGLISH_STOPWORDS),
    required: Sequence[str] = tuple(REQUIRED_COLUMNS),
) -> DataFrame:
    """Complete rows, one per title and date, with paths, date parts and filtered text.

    One shuffle (the de-duplication); everything after it is one projection.
    """
    complete = drop_nulls_subset(df, required)
    order = [F.col("vote_count").desc_nulls_last(), F.col("id").asc()]
    unique = dedup_keep_first(complete, ["title", "release_date"], order)
    dated = date_parts(prefix_path(unique, "poster_path", base_url), "release_date", "release")
    with_text = concat_fill(dated, "text", "overview", "tagline", "keywords")
    return token_filter(with_text, "text", "processed_text", stopwords)


def run_clean(
    spark: SparkSession,
    catalog_csv: str | list[str],
    out: str,
    base_url: str,
    chunk_size: int = ROWS_PER_FILE,
    multi_line: bool = True,
    stopwords: Sequence[str] = tuple(ENGLISH_STOPWORDS),
) -> dict[str, str]:
    """Read, clean and write in chunks without line breaks in the fields; the profiles before and after are counted on the way.

    The catalogue is read once, and what was written not at all: both profiles are observed by the job that writes.
    """
    catalog, before = observed_profile(read_catalog_csv(spark, catalog_csv, CATALOG_SCHEMA, multi_line=multi_line))
    cleaned, after = observed_profile(scrub_newlines(clean_catalog(catalog, base_url, stopwords)), empty_is_null=True)
    paths = {"cleaned": write_csv_chunked(cleaned, f"{out}/cleaned", chunk_size, null_value="")}
    for name, profile in (("profile_before", before), ("profile_after", after)):
        paths[name] = write_result_csv(profile.rows(spark), f"{out}/{name}", True)
    return paths
