"""Token ids in binary pages, with a minimal perfect hash index from document keys to their place.

Files, all below one folder and all written and read by Spark, so that they can lie in any shared store:

* ``pages``: one row per page: ``shard, page, first_id`` (ids before it in the shard), the raw ids of whole
  documents as little-endian unsigned 32-bit numbers, and a directory of the documents in it (``keys, copies, lengths``).
  Documents stand in ascending order of the key; a shard is a range of keys.
* ``index``: one row per bucket of about 65,000 keys: the bit arrays of a minimal perfect hash
  (a key's first free position among levels of bits; its rank is its number), ranks before each word of
  bits, and for every number a 32-bit fingerprint of the key and its shard, page, offset and length.

A lookup hashes the key to its bucket, reads one or two words of bits, and compares the fingerprint: constant time.
A row that repeats a key is a copy, numbered from 1 on, and is found under (key, copy).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, small_batches, stored
from shelfmark.llm.encoding import encoder
from shelfmark.llm.words import mix

_LEVELS = 40
_GAMMA = 2
_PLACE = ("shard", "page", "at", "n")


def _hash(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """One-to-one on keys without copies."""
    return mix(keys.astype(np.uint64) + mix(copies.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype("<u4")


def _position(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0x9FB21C651E98DF25 % 2**64)) % np.uint64(size)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes in bits, words of bits, rank before each word, and hashes left over (none, unless two are equal)."""
    sizes, words, left = [], [], h
    for level in range(_LEVELS):
        if not len(left):
            break
        size = max(64, -(-_GAMMA * len(left) // 64) * 64)
        at = _position(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    bits = np.concatenate(words) if words else np.zeros(0, "<u8")
    ranks = np.append(0, np.cumsum(np.bitwise_count(bits).astype(np.int64)))[:-1].astype("<u4")
    return np.array(sizes, "<i4"), bits, ranks, np.sort(left)


def numbers(h: np.ndarray, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The number of each hash; for hashes that are not in the index any number, or -1."""
    out, open_, base = np.full(len(h), -1, dtype=np.int64), np.arange(len(h)), 0
    for level, size in enumerate(sizes):
        at = _position(h[open_], level, int(size)) + base
        word, mask = bits[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
        hit = (word & mask) != 0
        below = np.bitwise_count(word & (mask - np.uint64(1))).astype(np.int64)
        out[open_[hit]] = (ranks[at >> 6] + below)[hit]
        open_, base = open_[~hit], base + int(size)
    if len(rest) and len(open_):
        i = np.searchsorted(rest, h[open_]).clip(0, len(rest) - 1)
        same = rest[i] == h[open_]
        out[open_[same]] = int(np.bitwise_count(bits).sum()) + i[same]
    return out


def write_pages(
    docs: DataFrame, root: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, page_ids: int = 1 << 18, special: bool = False
) -> None:
    """Encode every text, append ``end_id`` and write the pages. A null text is empty; rows without a key come first."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, page, first = encoder(path, special), TaskContext.get().partitionId(), 0, 0
        keys, copies, lengths, parts, held = [], [], [], [], 0
        last, copy = object(), 0

        def flush():
            values = [[shard], [page], [first], [held], [keys], [copies], [lengths], [b"".join(parts)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(value or "") + end
                copy, last = copy + 1 if k == last else 0, k
                keys.append(k)
                copies.append(copy)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= page_ids:
                    yield flush()
                    first, page = first + held, page + 1
                    keys, copies, lengths, parts, held = [], [], [], [], 0
        if keys:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                        ("keys", pa.list_(pa.int64())), ("copies", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())),
                        ("ids", pa.binary())])
    ddl = "shard int, page int, first_id long, n_ids long, keys array<long>, copies array<int>, lengths array<int>, ids binary"
    small_batches(docs.sparkSession)
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(F.asc("k")).sortWithinPartitions("k", "t")
    ordered.mapInArrow(make, ddl).write.option("compression", "zstd").parquet(f"{root}/pages")


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/pages")


def _directory(batch: pa.RecordBatch) -> dict[str, np.ndarray | pa.Array]:
    """One row per document of the pages, without its ids."""
    keys, copies, lengths = (batch.column(c) for c in ("keys", "copies", "lengths"))
    per_page = np.diff(keys.offsets.to_numpy())
    n = lengths.flatten().to_numpy().astype(np.int64)
    before = np.append(0, np.cumsum(n))[:-1]
    starts = np.append(0, np.cumsum(per_page))[:-1]
    at = before - np.repeat(before[starts.clip(0, max(len(n) - 1, 0))] if len(n) else before, per_page)
    return {"k": keys.flatten(), "copy": copies.flatten(), "shard": np.repeat(batch.column("shard").to_numpy(), per_page),
            "page": np.repeat(batch.column("page").to_numpy(), per_page), "at": at.astype(np.int32), "n": n.astype(np.int32)}


def build_index(spark: SparkSession, root: str, bucket_keys: int = 1 << 16) -> None:
    """Index the pages below ``root``; about ``bucket_keys`` keys to a bucket, so a task's memory is bounded."""
    places = stored(
        map_batches(_pages(spark, root).select("shard", "page", "keys", "copies", "lengths"), lambda b: [_directory(b)],
                    "k long, copy int, shard int, page int, at int, n int").filter("k IS NOT NULL"), "places")
    buckets = max(1, -(-places.count() // bucket_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hash(pdf["k"].to_numpy(), pdf["copy"].to_numpy())
        sizes, bits, ranks, rest = perfect_hash(h)
        order = np.empty(len(h), dtype=np.int64)
        order[numbers(h, sizes, bits, ranks, rest)] = np.arange(len(h))
        row = {"bucket": pdf["bucket"].iloc[0], "buckets": buckets, "sizes": sizes.tobytes(), "bits": bits.tobytes(), "ranks": ranks.tobytes(),
               "rest": rest.astype("<u8").tobytes(), "fingerprints": _fingerprint(h)[order].tobytes()}
        row |= {c: pdf[c].to_numpy().astype("<i4")[order].tobytes() for c in _PLACE}
        return pd.DataFrame([row])

    schema = "bucket long, buckets long, sizes binary, bits binary, ranks binary, rest binary, fingerprints binary, shard binary, page binary, at binary, n binary"
    index = with_bucket(places, buckets).groupBy("bucket").applyInPandas(build, schema)
    index.write.option("compression", "zstd").parquet(f"{root}/index")


def with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    """Add the bucket of ``(k, copy)``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields)

    def add(batch: pa.RecordBatch):
        h = _hash(batch.column("k").to_numpy(), batch.column("copy").to_numpy())
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        yield {c: batch.column(c) for c in batch.schema.names} | {"bucket": bucket}

    return map_batches(keys, add, f"{schema}, bucket long")


def lookup(keys: DataFrame, root: str) -> DataFrame:
    """``(k, copy, shard, page, at, n)`` of those rows of ``keys (k long, copy int)`` that the index holds.

    Rows should be distinct. A key that is not there passes the fingerprint once in 2**32.
    """
    index = keys.sparkSession.read.parquet(f"{root}/index")
    buckets = index.select("buckets").first()
    if buckets is None:
        return keys.limit(0).select("k", "copy", *(F.lit(0).alias(c) for c in _PLACE))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = right.iloc[0] if len(right) else None
        if row is None or not len(left):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("k", "copy", *_PLACE)})
        h = _hash(left["k"].to_numpy(), left["copy"].to_numpy())
        kinds = {"sizes": "<i4", "bits": "<u8", "ranks": "<u4", "rest": "<u8", "fingerprints": "<u4", **dict.fromkeys(_PLACE, "<i4")}
        a = {c: np.frombuffer(row[c], t) for c, t in kinds.items()}
        number = numbers(h, a["sizes"], a["bits"], a["ranks"], a["rest"])
        held = (number >= 0) & (a["fingerprints"][number] == _fingerprint(h))
        return pd.DataFrame({"k": left["k"][held], "copy": left["copy"][held], **{c: a[c][number[held]] for c in _PLACE}})

    grouped = with_bucket(keys.select("k", "copy"), buckets[0]).groupBy("bucket")
    return grouped.cogroup(index.groupBy("bucket")).applyInPandas(find, "k long, copy int, shard int, page int, at int, n int")


def fetch(keys: DataFrame, root: str) -> DataFrame:
    """``(k, copy, ids)`` of the given keys: only the pages that hold one are taken apart."""
    found = lookup(keys, root)
    pages = _pages(keys.sparkSession, root).select("shard", "page", "ids")
    return found.join(pages, ["shard", "page"]).select("k", "copy", F.substring("ids", F.col("at") * 4 + 1, F.col("n") * 4).alias("ids"))


def page_digests(spark: SparkSession, root: str) -> DataFrame:
    """``(k, copy, shard, page, at, n, first, crc)`` of every document, from the ids in the pages."""

    def make(batch: pa.RecordBatch):
        out = _directory(batch)
        pages = [memoryview(x.as_buffer()) for x in batch.column("ids")]
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("keys").offsets.to_numpy()))
        crc = [zlib.crc32(pages[r][a * 4:(a + n) * 4]) for r, a, n in zip(row.tolist(), out["at"].tolist(), out["n"].tolist())]
        yield out | {"first": batch.column("first_id").to_numpy()[row] + out["at"], "crc": np.array(crc, dtype=np.int64)}

    schema = "k long, copy int, shard int, page int, at int, n int, first long, crc long"
    return map_batches(_pages(spark, root).select("shard", "page", "first_id", "keys", "copies", "lengths", "ids"), make, schema)


def stored_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every stored document: its place looked up in the index by its key, its digest
    taken from the ids at that place. ``start`` counts the ids of all documents before it.

    Documents without a key have no entry in the index and are returned from their pages.
    """
    digests = stored(page_digests(spark, root), "digests")
    found = stored(lookup(digests.filter("k IS NOT NULL").select("k", "copy"), root), "found")
    # One row per shard, that is per task that wrote.
    totals = _pages(spark, root).groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    own = digests.withColumnsRenamed({"k": "_k", "copy": "_copy", "n": "_n"})
    placed = found.join(own.filter("_k IS NOT NULL"), list(_PLACE[:3])).filter("n = _n AND k = _k AND copy = _copy")
    rows = placed.select("k", "shard", "first", "n", "crc").union(own.filter("_k IS NULL").select("_k", "shard", "first", "_n", "crc"))
    return rows.join(bases, "shard").select(
        F.col("k").alias("doc_id"), (F.col("base") + F.col("first")).alias("start"), F.col("n").cast("long").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )
