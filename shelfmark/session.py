"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from shelfmark.sinks.folders import delete

# Skewed joins are split by map-output blocks at run time, which stays exact even when the hot
# rows are identical copies; a content-based salt could not spread those.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; ``conf`` keys use ``__`` for dots (``spark__ui__enabled``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Set ``SESSION_CONF`` on a session made elsewhere; all of them can be changed at run time."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``, or else below the warehouse folder.

    On a cluster executors share both.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse').rstrip('/')}/_scratch"
    root = f"{base.rstrip('/')}/shelfmark-{uuid.uuid4().hex}"
    for made in _COLLECTING:
        made.append(root)
    return f"{root}/{label}"


_COLLECTING: list[list[str]] = []


@contextmanager
def scratch_made() -> Iterator[list[str]]:
    """The scratch folders that are asked for inside the block, for ``free_scratch`` later on."""
    made: list[str] = []
    _COLLECTING.append(made)
    try:
        yield made
    finally:
        _COLLECTING.remove(made)


def free_scratch(spark: SparkSession, made: list[str], needed: DataFrame) -> None:
    """Delete the folders ``made``, but for those that ``needed`` still reads, which stay in the list.

    To be called when what was made from them is written, since a later read would miss them.
    """
    files = needed.inputFiles() if made else []
    read = {part for f in files for part in f.split("/") if part.startswith("shelfmark-")}
    for root in list(made):
        if root.rsplit("/", 1)[-1] not in read:
            delete(spark, root)
            made.remove(root)
