"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a row holds, for a run of whole documents, the postings (places of words) of
each test term in them, sorted by term and place. It is written to the shared folder. Its terms are the words of the
benchmark; every document is in it. Each window of a test text is then looked up in every row: from the window's term that is
rarest in the whole corpus, candidates are the places in its list less its offset, and they are intersected with
the lists of the other terms, the next rarest first, each shifted by its offset.

The benchmark is taken in blocks of bounded size, each with an index of its own terms, so what is sent to the
tasks is bounded. Words are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored
from shelfmark.llm.words import SYMBOLS, groups_by_size, raw_text, words

_CHUNK = 1 << 22


@dataclass
class Windows:
    """Windows of the test items: term numbers (-1 beyond a short window), widths, item of each; names of items; sorted terms."""

    terms: np.ndarray
    widths: np.ndarray
    item: np.ndarray
    names: list[str]
    vocabulary: np.ndarray


def windows_of(items: list[tuple[str, str | None]], width: int) -> Windows:
    """All runs of ``width`` words of each item; an item of fewer, but not none, is one window."""
    buf, off = raw_text(pa.array([text for _, text in items], pa.string()))
    _, _, hashes, first = words(buf, off, SYMBOLS)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    rows, widths, item = [], [], []
    for i in range(len(items)):
        own = number[first[i]:first[i + 1]]
        n = min(width, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            rows.append(np.append(own[a:a + n], np.full(width - n, -1)))
            widths.append(n)
            item.append(i)
    terms = np.array(rows, dtype=np.int64).reshape(len(rows), width)
    return Windows(terms, np.array(widths, dtype=np.int64), np.array(item, dtype=np.int64), [name for name, _ in items], vocabulary)


def build_index(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """``(part, row, keys, first, terms, begins, places)``: postings of the terms in runs of documents.

    ``first`` says where each document's words begin among the run's words, ``begins`` where each term's places begin.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the words of one block of the benchmark
    kind = docs.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, part, row = known.value, TaskContext.get().partitionId(), 0
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[(vocab & np.uint64(maybe.size - 1)).astype(np.int64)] = True
        for batch in batches:
            buf, off = raw_text(batch.column(1))
            for lo, hi in groups_by_size(np.diff(off), _CHUNK):
                span = off[lo:hi + 1]
                _, _, hashes, first = words(buf[span[0]:span[-1]], span - span[0], SYMBOLS)
                place = np.flatnonzero(maybe[(hashes & np.uint64(maybe.size - 1)).astype(np.int64)])
                at = np.searchsorted(vocab, hashes[place]).clip(0, max(len(vocab) - 1, 0))
                same = vocab[at] == hashes[place] if len(vocab) else np.zeros(len(place), dtype=bool)
                term, place = at[same].astype(np.int32), place[same]
                order = np.argsort(term, kind="stable")
                terms, begins = np.unique(term[order], return_index=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([row], pa.int32()), pa.ListArray.from_arrays([0, hi - lo], batch.column(0).slice(lo, hi - lo)),
                    pa.array([first.tolist()], pa.list_(pa.int64())), pa.array([terms.tolist()], pa.list_(pa.int32())),
                    pa.array([np.append(begins, len(order)).tolist()], pa.list_(pa.int32())),
                    pa.array([place[order].astype("<u4").tobytes()], pa.binary()),
                ], names)
                row += 1

    names = ["part", "row", "keys", "first", "terms", "begins", "places"]
    schema = f"part int, row int, keys array<{kind}>, first array<long>, terms array<int>, begins array<int>, places binary"
    return docs.select(key, text).mapInArrow(make, schema)


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each term in all documents; at most ``size`` rows reach the driver."""
    at = F.posexplode("terms").alias("i", "term")
    counts = index.select(at, "begins").select("term", (F.get("begins", F.col("i") + 1) - F.get("begins", "i")).alias("n"))
    out = np.zeros(size, dtype=np.int64)
    for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def match_rows(windows: Windows, order: np.ndarray, first: np.ndarray, terms: np.ndarray, begins: np.ndarray, places: np.ndarray, slop: int):
    """``(window, start)`` of all matches in one row of the index.

    ``order`` has each window's offsets from the rarest term on. Each term must stand within ``slop`` places of its own in the window.
    """
    n_words = int(first[-1]) if len(first) else 0
    if not len(terms) or not n_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.full(len(windows.vocabulary) + 1, -1, dtype=np.int64)
    number[terms] = np.arange(len(terms))
    local = number[windows.terms]
    present = ((local >= 0) | (windows.terms < 0)).all(axis=1)
    which = np.flatnonzero(present)
    if not len(which):
        return which, which
    anchor = local[which, order[which, 0]]
    size = (begins[anchor + 1] - begins[anchor]).astype(np.int64)
    window = np.repeat(which, size)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    start = places[np.repeat(begins[anchor], size) + within].astype(np.int64) - order[window, 0]
    doc = np.searchsorted(first, start, "right") - 1
    inside = (start >= 0) & (start + windows.widths[window] <= n_words)
    inside[inside] &= start[inside] + windows.widths[window[inside]] <= first[doc[inside] + 1]
    window, start = window[inside], start[inside]
    # Term by place, in the order of the postings: one sorted array for all lists.
    span = np.int64(n_words + 2 * slop + 1)
    listed = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(begins)) * span + places + slop
    for step in range(1, windows.terms.shape[1]):
        some = windows.widths[window] > step
        offset = order[window, step]
        wanted = local[window, offset] * span + start + offset
        at = np.searchsorted(listed, wanted).clip(0, len(listed) - 1)
        held = (listed[at] >= wanted) & (listed[at] <= wanted + 2 * slop)
        window, start = window[held | ~some], start[held | ~some]
    return window, start


def find_matches(index: DataFrame, key: str, windows: Windows, slop: int = 0) -> DataFrame:
    """``(part, row, i, key, n_words, hits, items)`` of every document: places of its words in a match, and matching items."""
    counts = term_counts(index, len(windows.vocabulary))
    rarity = np.where(windows.terms < 0, np.iinfo(np.int64).max, np.append(counts, 0)[windows.terms])
    shared = index.sparkSession.sparkContext.broadcast((windows, np.argsort(rarity, axis=1, kind="stable")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, order = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                part, row, keys, first, terms, begins, places = (batch.column(c)[r] for c in range(7))
                first = first.values.to_numpy()
                found = match_rows(win, order, first, terms.values.to_numpy(), begins.values.to_numpy(), np.frombuffer(places.as_py(), "<u4"), slop)
                n = len(first) - 1
                hit = np.zeros(int(first[-1]) + 1, dtype=np.int64)
                np.add.at(hit, found[1], 1)
                np.add.at(hit, found[1] + win.widths[found[0]], -1)
                places_hit = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
                owner = np.searchsorted(first, places_hit, "right") - 1
                hits = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), pa.array((places_hit - first[owner]).astype(np.int32)))
                pairs = np.unique(np.stack([np.searchsorted(first, found[1], "right") - 1, win.item[found[0]]], axis=1), axis=0)
                items = pa.ListArray.from_arrays(np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32),
                                                 pa.array([win.names[i] for i in pairs[:, 1]], pa.string()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.as_py()] * n, pa.int32()), pa.array([row.as_py()] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)),
                    keys.values, pa.array(np.diff(first)), hits, items], names)

    kind = index.schema["keys"].dataType.elementType.simpleString()
    names = ["part", "row", "i", key, "n_words", "hits", "items"]
    return index.mapInArrow(make, f"part int, row int, i int, {key} {kind}, n_words long, hits array<int>, items array<string>")


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = 10, slop: int = 0, block_chars: int = 1 << 24,
) -> DataFrame:
    """``(key, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``, and ``items``, the ids.

    Words: runs of ASCII letters and digits and of all other non-ASCII signs, A-Z lower-cased. A null text has none, and a
    null test text no window. ``slop`` above 0 also finds near matches, with every word at most so many places off. Equal
    item ids count once; an item without an id counts as the empty name. Rows with equal or null keys are each told
    apart. Further columns are ignored.
    """
    own = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    tests = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("test"))
    total = tests.agg(F.sum(F.length("test"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    if blocks > 1:
        tests = stored(tests, "tests")
    results = []
    for b in range(blocks):
        # One block's texts, of about block_chars, come to the driver.
        block = tests.filter(F.pmod(F.xxhash64("name", "test"), F.lit(blocks)) == b).collect()
        windows = windows_of([(r["name"], r["test"]) for r in block], width)
        index = stored(build_index(own, "_k", "_t", windows.vocabulary), "postings")
        results.append(find_matches(index, "_k", windows, slop))
    found = results[0]
    if blocks > 1:
        for r in results[1:]:
            found = found.union(r)
        found = found.groupBy("part", "row", "i").agg(
            F.first("_k").alias("_k"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    items = F.sort_array(F.array_distinct("items"))
    return found.select(
        F.col("_k").alias(key), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), items.alias("items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark. Rows are told apart by key and text."""
    mark = [F.xxhash64(key, text), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))]
    own = docs.select(F.struct(mark[0].alias("a"), mark[1].alias("b")).alias("_mark"), F.col(text).alias("_t"))
    found = contamination(own, benchmark, "_mark", "_t").filter("contaminated").select("_mark.a", "_mark.b").distinct()
    bad = stored(found.withColumnsRenamed({"a": "__a", "b": "__b"}), "contaminated")
    return docs.join(bad, (mark[0] == F.col("__a")) & (mark[1] == F.col("__b")), "left_anti")
