"""A corpus pipeline from raw documents to packed token sequences.

Each stage works on all rows that the one before it kept, written as parquet to the shared folder between them. All
but the last return rows with the columns of ``documents``. Each stage deletes the intermediate tables of the one before.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.decontaminate import without_contaminated
from shelfmark.llm.jaccard import one_of_each_group
from shelfmark.llm.language import known_language
from shelfmark.llm.packing import pack_documents
from shelfmark.llm.secrets import mask_secrets, scan_secrets
from shelfmark.session import free_scratch, scratch_made, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognisable language go."""
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share at least 0.8 of their five-word shingles, directly or through others, one stays."""
    return one_of_each_group(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no text goes."""
    return mask_secrets(docs, scan_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048, special=True)


_LEFT: list[str] = []


def _freeing(stage: Stage) -> Stage:
    """``stage``, which first deletes the intermediate tables of the stage before: its rows have been written and read again."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_scratch(spark, _LEFT, docs)
        with scratch_made() as made:
            rows = stage(spark, docs, sf_dir)
        _LEFT.extend(made)
        return rows

    return run_stage


STAGES = [(stage.__name__, _freeing(stage)) for stage in (language_id, near_duplicates, decontaminate, secrets, pack)]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
