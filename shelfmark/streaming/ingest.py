"""Incremental ingest of raw record drops into a catalogue folder."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from shelfmark.operators.dedup import dedup_by_id, quarantine_missing
from shelfmark.sinks.keyed import BUCKET_ROWS, FOLDERS_PER_BUCKET, KeyedTable
from shelfmark.sources.readers import CORRUPT, with_corrupt


def ingest_increment(
    spark: SparkSession,
    drops: str,
    target: str,
    checkpoint: str,
    schema: T.StructType,
    key: str,
    order: Sequence[Column],
    quarantine: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    files_per_batch: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
    folders_per_bucket: int = FOLDERS_PER_BUCKET,
) -> None:
    """Add the records of all new files in ``drops`` to ``target``, the first record per ``key``.

    Runs until the files present at the start are taken, then ends. Each file is taken once; the
    checkpoint remembers which. ``target`` is a ``KeyedTable`` of ``schema`` (or what ``prepare`` makes of it), in buckets of ``bucket_rows`` rows that split
    when they are full and are written as one again when they have more than ``folders_per_bucket`` folders, so the number of files follows the
    rows, not the batches. What is already held is looked up there, in the folders that a batch's keys can meet, so no state
    grows with the number of ids, and a new checkpoint over an existing target adds only what it lacks.
    A batch is one commit, named by the query and the batch; when it runs again after a failure it either finds itself committed or
    overwrites what it left. Unreadable records and those without a key go to ``quarantine``.
    ``files_per_batch`` cuts a large backlog into several batches.
    """
    reader = spark.readStream.schema(with_corrupt(schema)).option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    records = reader.json(drops)

    def add_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        query_id = json.loads(session.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        batch = batch.persist()
        try:
            good, bad = quarantine_missing(batch, key, CORRUPT)
            if not bad.isEmpty():
                bad.write.mode("overwrite").parquet(f"{quarantine}/run={query_id}/batch={batch_id}")
            first = dedup_by_id(prepare(good.drop(CORRUPT)), key, order)
            table = KeyedTable(session, target, first.schema, key, bucket_rows=bucket_rows, folders_per_bucket=folders_per_bucket)
            table.insert(first, tag=f"{query_id}/{batch_id}")
        finally:
            batch.unpersist()

    query = (
        records.writeStream.foreachBatch(add_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_ingested(spark: SparkSession, target: str, schema: T.StructType, key: str) -> DataFrame:
    """The catalogue that ``ingest_increment`` has written; without rows where nothing was taken in yet."""
    return KeyedTable(spark, target, schema, key).read()
