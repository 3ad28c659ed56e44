"""Raw records to catalogue rows, and the daily merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.dedup import dedup_by_id, quarantine_missing
from shelfmark.operators.project import (
    default_fill_cast,
    flatten_struct_array,
    scrub_newlines,
    sentinel_to_null,
)
from shelfmark.operators.rank import sort_by_score
from shelfmark.operators.relate import anti_join_pending, id_frontier, union_by_name
from shelfmark.schema import (
    CATALOG_SCHEMA,
    MISSING_DATE,
    NESTED_NAMES,
    RAW_SCHEMA,
    SENTINELS,
    TYPED_DEFAULTS,
)
from shelfmark.sinks.keyed import KeyedTable
from shelfmark.sinks.writers import write_csv_quoteall_sorted
from shelfmark.sources.readers import CORRUPT, read_catalog_csv, read_ndjson
from shelfmark.streaming.ingest import ingest_increment, read_ingested


def flatten_records(raw: DataFrame) -> DataFrame:
    """Nested raw records as flat catalogue rows, in one projection."""
    flat = flatten_struct_array(raw, NESTED_NAMES)
    clean = sentinel_to_null(flat, sentinels=[*SENTINELS, MISSING_DATE])
    typed = default_fill_cast(clean, TYPED_DEFAULTS)
    return scrub_newlines(typed).select(*CATALOG_SCHEMA.names)


def content_order(df: DataFrame, *first):
    """``first`` and a hash of the row, so that the survivor of a tie does not depend on timing."""
    return [*first, F.xxhash64(*(F.col(c) for c in df.columns))]


def merge_daily(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """Old rows and new rows, the new one where both have the key, highest score first.

    A key that repeats in ``old`` or in ``new`` keeps the row with the highest score. Rows are cut to one per key and task
    before they are shuffled.
    """
    newest = dedup_by_id(new, key, content_order(new, F.col(score).desc_nulls_last()))
    unmatched = anti_join_pending(old, newest, key)
    kept = dedup_by_id(unmatched, key, content_order(unmatched, F.col(score).desc_nulls_last()))
    return sort_by_score(union_by_name(kept, newest), score, key)


def merge_increment(table: KeyedTable, new: DataFrame, tag: str | None = None) -> None:
    """``merge_daily`` into a stored catalogue: the newest row per key, in the place of the one held.

    Of a key that repeats in ``new`` the row with the highest score counts. Only folders that hold a key of ``new`` are written
    anew, so the bytes written follow the increment; ``tag`` names the run, and a run repeated right after itself does nothing. The order by score is made when
    the table is read (``sort_by_score``), and ``KeyedTable.top`` reads only folders whose scores are high enough.
    """
    rows = new.filter(F.col(table.key).isNotNull())
    table.replace(dedup_by_id(rows, table.key, content_order(rows, F.col(table.score).desc_nulls_last())), tag)


def write_catalog(merged: DataFrame, path: str) -> str:
    """The catalogue as sorted CSV without line breaks in its fields, so that it can be read in parallel."""
    return write_csv_quoteall_sorted(scrub_newlines(merged), path, "vote_count", "id")


def run_harvest(
    spark: SparkSession, old_csv: str | list[str], drops: str | list[str], out: str, multi_line: bool = True
) -> str:
    """Merge NDJSON drops into a CSV catalogue; unreadable records go next to it.

    ``multi_line=False`` is for an old catalogue without line breaks in its fields, such as this job writes.
    """
    good, bad = quarantine_missing(read_ndjson(spark, drops, RAW_SCHEMA), "id", CORRUPT)
    bad.write.mode("error").json(f"{out}/quarantine")
    old = read_catalog_csv(spark, old_csv, CATALOG_SCHEMA, multi_line=multi_line)
    merged = merge_daily(old, flatten_records(good), "id", "vote_count")
    return write_catalog(merged, f"{out}/catalog")


def run_increment(
    spark: SparkSession, old_csv: str | list[str], drops: str, state: str, out: str, latest: int | None = None, multi_line: bool = True
) -> dict[str, str]:
    """One incremental run: take the new drops in, flatten all that is held, merge it, and list the ids still to fetch.

    ``state`` keeps what was taken in, the checkpoint and the quarantine from run to run. With ``latest``, the highest id
    there is upstream, the ids above the catalogue's highest one that no record was held for go to ``out/pending``.
    """
    held_path = f"{state}/held"
    ingest_increment(
        spark, drops, held_path, f"{state}/checkpoint", RAW_SCHEMA, "id", [F.col("vote_count").desc_nulls_last()],
        quarantine=f"{state}/quarantine",
    )
    held = read_ingested(spark, held_path, RAW_SCHEMA, "id")
    old = read_catalog_csv(spark, old_csv, CATALOG_SCHEMA, multi_line=multi_line)
    paths = {"catalog": write_catalog(merge_daily(old, flatten_records(held), "id", "vote_count"), f"{out}/catalog")}
    if latest is not None:
        pending = id_frontier(old, "id", latest, done=held.select("id"))
        pending.write.json(f"{out}/pending")
        paths["pending"] = f"{out}/pending"
    return paths
