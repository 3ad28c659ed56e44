"""A table with one row per key, in hash buckets that split when they are full.

The rows lie in parquet folders, each the part of one bucket that one commit has written. A bucket holds the keys whose hash ends in given
bits; when it has more rows than it may, it is dealt anew by more bits (extendible hashing), so a first load of any
size writes as many buckets, each by a task of its own, as its rows call for. The directory of buckets and folders, with the rows and the
lowest and highest key and score of each folder, is a small table beside the data, written anew by every commit. A
commit is what its directory says: until that is written, readers see the state before, and a commit that broke off is overwritten by the next.
A commit reads only folders whose keys can meet the new ones, and writes only new rows, folders that hold a replaced key, and
buckets that split or have too many folders. One writer at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.relate import anti_join_pending, semi_join_available
from shelfmark.sinks.folders import delete, names

DEPTH, VALUE, FOLDER = "_depth", "_value", "_folder"
BUCKET_ROWS = 1_000_000
FOLDERS_PER_BUCKET = 8


@dataclass(frozen=True)
class Part:
    """A folder of the table: bits of the bucket's hash and their value, rows, and the lowest and highest key and score."""

    depth: int
    value: int
    folder: str
    rows: int
    low_key: object
    high_key: object
    low_score: object = None
    high_score: object = None

    @property
    def bucket(self) -> tuple[int, int]:
        return self.depth, self.value


def _hash(key: str) -> Column:
    return F.xxhash64(key)


class KeyedTable:
    """The table at ``path``: ``insert`` keeps the rows held, ``replace`` the new ones; ``read`` gives all rows.

    ``score`` names a column whose range the directory also notes.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, score: str | None = None,
        bucket_rows: int = BUCKET_ROWS, folders_per_bucket: int = FOLDERS_PER_BUCKET,
    ):
        self.spark, self.path, self.schema, self.key, self.score = spark, path.rstrip("/"), schema, key, score
        self.bucket_rows, self.folders_per_bucket = bucket_rows, folders_per_bucket

    # The directory.

    def versions(self) -> list[int]:
        """Numbers of the commits whose directories are there, ascending."""
        found = [n for n in names(self.spark, f"{self.path}/directory") if n.startswith("v=")]
        return sorted(int(n[2:]) for n in found if "_SUCCESS" in names(self.spark, f"{self.path}/directory/{n}"))

    def parts(self, version: int | None = None) -> list[Part]:
        """The folders of a commit, the last one by default."""
        if version is None:
            version = max(self.versions(), default=0)
        return [Part(*r[:8]) for r in self._rows(version) if r["folder"] is not None]

    def tag(self) -> str | None:
        """What the last commit was called."""
        rows = self._rows(max(self.versions(), default=0))
        return rows[0]["tag"] if rows else None

    def _rows(self, version: int) -> list:
        return self.spark.read.schema(self._directory_schema()).parquet(f"{self.path}/directory/v={version}").collect() if version else []

    def _directory_schema(self) -> T.StructType:
        key = self.schema[self.key].dataType
        score = self.schema[self.score].dataType if self.score else T.LongType()
        kinds = [("depth", T.IntegerType()), ("value", T.LongType()), ("folder", T.StringType()), ("rows", T.LongType()), ("low_key", key), ("high_key", key),
                 ("low_score", score), ("high_score", score), ("tag", T.StringType())]
        return T.StructType([T.StructField(n, t) for n, t in kinds])

    # Reading.

    def read(self, parts: Sequence[Part] | None = None) -> DataFrame:
        """The rows of all folders, or of some."""
        return self._read(self.parts() if parts is None else parts).select(*self.schema.names)

    def _read(self, parts: Sequence[Part]) -> DataFrame:
        inner = T.StructType([*self.schema.fields, T.StructField(DEPTH, T.IntegerType()), T.StructField(VALUE, T.LongType())])
        if not parts:
            return self.spark.createDataFrame([], inner).withColumn(FOLDER, F.lit(None).cast("string"))
        reader = self.spark.read.schema(inner).option("basePath", f"{self.path}/data")
        folder = F.regexp_extract("_metadata.file_path", r"data/(_commit=\d+/_depth=\d+/_value=\d+)/[^/]*$", 1)
        found = reader.parquet(*(f"{self.path}/data/{p.folder}" for p in parts))
        return found.select(*self.schema.names, DEPTH, VALUE, folder.alias(FOLDER))

    def top(self, n: int) -> DataFrame:
        """The ``n`` rows with the highest score, then the smallest key, from the folders that can have one of them."""
        ranked = sorted((p for p in self.parts() if p.high_score is not None), key=lambda p: p.low_score, reverse=True)
        held, least = 0, None
        for p in ranked:  # at least n rows have this score
            held += p.rows
            if held >= n:
                least = p.low_score
                break
        able = [p for p in self.parts() if least is None or (p.high_score is not None and p.high_score >= least)]
        return self.read(able).orderBy(F.col(self.score).desc_nulls_last(), self.key).limit(n)

    # Writing.

    def insert(self, rows: DataFrame, tag: str | None = None) -> None:
        """Add the rows whose key is not held. ``rows`` have each key once and none without; a commit of the tag of the last one does nothing."""
        self._commit(rows, tag, keep_held=True)

    def replace(self, rows: DataFrame, tag: str | None = None) -> None:
        """Add the rows, in the place of those that are held with their keys; otherwise as ``insert``."""
        self._commit(rows, tag, keep_held=False)

    def _in_buckets(self, rows: DataFrame, buckets: set[tuple[int, int]]) -> DataFrame:
        """``rows`` with the bucket each falls in. Buckets differ in few depths, and each row tries these."""
        depths = sorted({d for d, _ in buckets})
        if len(depths) == 1:
            return rows.withColumns({DEPTH: F.lit(depths[0]), VALUE: _hash(self.key).bitwiseAND(F.lit((1 << depths[0]) - 1))})
        tries = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), _hash(self.key).bitwiseAND(F.lit((1 << d) - 1)).alias("v")) for d in depths)))
        known = self.spark.createDataFrame(sorted(buckets), f"{DEPTH} int, {VALUE} long")
        tried = rows.withColumn("_try", tries).withColumns({DEPTH: F.col("_try.d"), VALUE: F.col("_try.v")}).drop("_try")
        return tried.join(known, [DEPTH, VALUE], "left_semi").select(*rows.columns, DEPTH, VALUE)

    def _commit(self, rows: DataFrame, tag: str | None, keep_held: bool) -> None:
        versions = self.versions()
        now = max(versions, default=0)
        if tag is not None and now and self.tag() == tag:
            return
        parts = self.parts(now)
        of_bucket = defaultdict(list)
        for p in parts:
            of_bucket[p.bucket].append(p)
        rows = self._in_buckets(rows.select(*self.schema.names), set(of_bucket) or {(0, 0)}).persist()
        try:
            span = rows.groupBy(DEPTH, VALUE).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"))
            met = {(r[DEPTH], r[VALUE]): (r["low"], r["high"]) for r in span.collect()}  # one row per bucket
            near = [p for b, (low, high) in met.items() for p in of_bucket[b] if p.high_key >= low and p.low_key <= high]
            rewritten: set[str] = set()
            if keep_held:
                new = anti_join_pending(rows, self._read(near), self.key) if near else rows
            else:
                new = rows
                if near:
                    hit = semi_join_available(self._read(near).select(self.key, FOLDER), rows, self.key)
                    rewritten = {r[FOLDER] for r in hit.groupBy(FOLDER).count().collect()}  # at most one row per folder
            self._write(new, rows, of_bucket, rewritten, tag, now, parts, versions)
        finally:
            rows.unpersist()

    def _write(self, new: DataFrame, rows: DataFrame, of_bucket: dict, rewritten: set[str], tag: str | None, now: int, parts: list[Part], versions: list[int]) -> None:
        spark, next_version = self.spark, now + 1
        added = {(r[DEPTH], r[VALUE]): r["count"] for r in new.groupBy(DEPTH, VALUE).count().collect()}
        deeper: dict[tuple[int, int], int] = {}
        for bucket, count in added.items():
            own = of_bucket[bucket]
            size = count + sum(p.rows for p in own)  # an upper bound, if some are replaced
            if size > self.bucket_rows:
                deeper[bucket] = bucket[0] + ceil(log2(size / self.bucket_rows))
            if bucket in deeper or len(own) - sum(p.folder in rewritten for p in own) >= self.folders_per_bucket:
                rewritten |= {p.folder for p in own}
        again = [p for p in parts if p.folder in rewritten]
        out = new
        if again:
            out = out.unionByName(anti_join_pending(self._read(again).drop(FOLDER), rows, self.key) if out is rows else self._read(again).drop(FOLDER))
        if deeper:
            more = spark.createDataFrame([(*b, d) for b, d in deeper.items()], f"{DEPTH} int, {VALUE} long, _deeper int")
            out = out.join(more, [DEPTH, VALUE], "left").withColumn(DEPTH, F.coalesce("_deeper", DEPTH)).drop("_deeper")
            bits = F.expr(f"shiftleft(1L, {DEPTH}) - 1")
            out = out.withColumn(VALUE, _hash(self.key).bitwiseAND(bits))
        targets = sum(1 << (deeper[b] - b[0]) if b in deeper else 1 for b in {*added, *(p.bucket for p in again)})
        data = f"{self.path}/data/_commit={next_version}"
        written: list[Part] = []
        if targets:
            writer = out.repartition(targets, DEPTH, VALUE).write.mode("overwrite").partitionBy(DEPTH, VALUE)
            writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(data)
            written = self._written(next_version)
        kept = [p for p in parts if p.folder not in rewritten]
        self._publish([*kept, *written], next_version, tag)
        self._clear(versions, [*kept, *written], parts)

    def _written(self, version: int) -> list[Part]:
        """The folders that a commit has written, from what is in them."""
        inner = T.StructType([*self.schema.fields, T.StructField(DEPTH, T.IntegerType()), T.StructField(VALUE, T.LongType())])
        df = self.spark.read.schema(inner).option("basePath", f"{self.path}/data/_commit={version}").parquet(f"{self.path}/data/_commit={version}")
        score = F.col(self.score) if self.score else F.lit(None).cast("long")
        ranges = df.groupBy(DEPTH, VALUE).agg(F.count(F.lit(1)), F.min(self.key), F.max(self.key), F.min(score), F.max(score))
        return [Part(r[0], r[1], f"_commit={version}/{DEPTH}={r[0]}/{VALUE}={r[1]}", *r[2:]) for r in sorted(ranges.collect(), key=lambda r: r[:2])]

    def _publish(self, parts: list[Part], version: int, tag: str | None) -> None:
        rows = [(p.depth, p.value, p.folder, p.rows, p.low_key, p.high_key, p.low_score, p.high_score, tag) for p in parts] or [(*[None] * 8, tag)]
        self.spark.createDataFrame(rows, self._directory_schema()).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/directory/v={version}")

    def _clear(self, versions: list[int], live: list[Part], before: list[Part]) -> None:
        """Delete what neither this state nor the one before needs; a reader may still be on that one."""
        needed = {p.folder for p in (*live, *before)}
        for old in versions[:-1]:
            for p in self.parts(old):
                if p.folder not in needed:
                    delete(self.spark, f"{self.path}/data/{p.folder}")
            delete(self.spark, f"{self.path}/directory/v={old}")
        used = {f.split("/")[0] for f in needed}
        for name in names(self.spark, f"{self.path}/data"):
            if name not in used:
                delete(self.spark, f"{self.path}/data/{name}")

