"""Ranked search for many queries at once: what the queries have in common is evaluated once.

The terms of a block of queries are numbered, and each document keeps its matches with them only: this table of postings is written
once and gives the statistics. Shared term sets are then mined among the queries: terms that occur in the same queries are one
set, and the pair of sets that most queries hold together becomes a new set, again and again. The result is a directed acyclic
graph of sums. For a batch of documents each node's accumulator, the documents' partial scores, is made once from the two
below it, and a query adds the few accumulators that are left to it. All scores are integers, so the order of the sums
does not matter and the result is that of the single queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, small_batches, stored
from shelfmark.llm.words import SYMBOLS, groups_by_size, raw_text, words

BLOCK_TERMS = 1 << 18  # terms of the queries that are evaluated together
MINED = 2048  # term sets among which pairs are mined; others are added one by one
CELLS = 1 << 22  # accumulators times documents held at once
_CHUNK = 1 << 22


@dataclass
class SharingPlan:
    """Sums that give every query: ``left`` and ``right`` of each added node (nodes 0 to ``terms`` - 1 are the terms), in levels, and
    the nodes each query adds up."""

    terms: int
    left: np.ndarray
    right: np.ndarray
    levels: list[np.ndarray]
    queries: list[np.ndarray]

    @property
    def additions(self) -> int:
        """Additions for a document, against the sum of all queries' terms without sharing."""
        return len(self.left) + sum(len(q) for q in self.queries)


def mine_sharing(queries: list[np.ndarray], terms: int, mined: int = MINED) -> SharingPlan:
    """Plan for queries given as arrays of distinct term numbers.

    Pairs are mined among the ``mined`` sets that most queries hold; this bounds the work and changes no result. Equal counts go to the
    smaller numbers, so the plan is the same in every run.
    """
    left: list[int] = []
    right: list[int] = []
    level = {}

    def join(a: int, b: int) -> int:
        left.append(a)
        right.append(b)
        node = terms + len(left) - 1
        level[node] = 1 + max(level.get(a, 0), level.get(b, 0))
        return node

    # Terms of exactly the same queries: one set, summed as a balanced tree.
    where: dict[int, list[int]] = {}
    for q, own in enumerate(queries):
        for t in own.tolist():
            where.setdefault(t, []).append(q)
    alike: dict[tuple[int, ...], list[int]] = {}
    for t in sorted(where):
        alike.setdefault(tuple(where[t]), []).append(t)
    sets: list[tuple[int, tuple[int, ...]]] = []
    rest: list[list[int]] = [[] for _ in queries]
    for holders, nodes in alike.items():
        if len(holders) == 1:  # nothing to share
            rest[holders[0]].extend(nodes)
            continue
        while len(nodes) > 1:
            nodes = [join(*nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        sets.append((nodes[0], holders))
    sets.sort(key=lambda s: (-len(s[1]), s[0]))
    for node, holders in sets[mined:]:
        for q in holders:
            rest[q].append(node)
    sets = sets[:mined]

    # The pair that most queries hold together becomes a set of its own.
    names = [node for node, _ in sets]
    held = np.zeros((len(queries), 2 * len(sets)), dtype=np.float32)
    for c, (_, holders) in enumerate(sets):
        held[list(holders), c] = 1
    size = held.shape[1]
    both = held.T @ held
    np.fill_diagonal(both, 0)
    most = both.max(axis=1, initial=0)
    while len(names) < size and (a := int(most.argmax())) is not None and most[a] >= 2:
        b = int(both[a].argmax())
        new = len(names)
        names.append(join(names[min(a, b)], names[max(a, b)]))
        shared = held[:, a] * held[:, b]
        held[:, a] -= shared
        held[:, b] -= shared
        held[:, new] = shared
        for c in (a, b, new):
            both[c] = both[:, c] = held[:, c] @ held
            both[c, c] = 0
        stale = np.flatnonzero(most)
        most[stale] = both[stale].max(axis=1)
        most[new] = both[new].max()
    own = [np.array(sorted(rest[q] + [names[c] for c in np.flatnonzero(held[q])]), dtype=np.int64) for q in range(len(queries))]
    depth = np.array([level[terms + i] for i in range(len(left))], dtype=np.int64)
    order = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
    return SharingPlan(terms, np.array(left, np.int64), np.array(right, np.int64), order, own)


def _per_text(column: pa.Array):
    """For runs of texts: first row, and per text its distinct word hashes, their counts and the number of words."""
    buf, off = raw_text(column)
    for lo, hi in groups_by_size(np.diff(off), _CHUNK):
        span = off[lo:hi + 1]
        _, _, hashes, first = words(buf[span[0]:span[-1]], span - span[0], SYMBOLS)
        yield lo, [(*np.unique(hashes[a:b].view(np.int64), return_counts=True), int(b - a)) for a, b in zip(first[:-1], first[1:])]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), kind))


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """``(_q, terms)``: the distinct terms of each query as 64-bit hashes, ascending."""

    def make(batch: pa.RecordBatch):
        for lo, own in _per_text(batch.column(1)):
            yield {"_q": batch.column(0).slice(lo, len(own)), "terms": _lists([t for t, _, _ in own], pa.int64())}

    return map_batches(queries.select("_q", text), make, "_q long, terms array<long>")


def matches(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``(key, n, term, tf)`` for every row with a term: its number of terms with repeats, and those among the (sorted) ``terms``
    by number, with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def make(batch: pa.RecordBatch):
        wanted = shared.value
        for lo, own in _per_text(batch.column(1)):
            number, tf = [], []
            for t, c, _ in own:
                at = np.minimum(np.searchsorted(wanted, t), max(len(wanted) - 1, 0))
                held = wanted[at] == t if len(wanted) else np.zeros(len(t), bool)
                number.append(at[held])
                tf.append(c[held])
            some = pa.array(np.array([n > 0 for _, _, n in own], dtype=bool))
            yield {
                "key": batch.column(0).slice(lo, len(own)).filter(some),
                "n": pa.array([n for _, _, n in own], pa.int64()).filter(some),
                "term": _lists(number, pa.int32()).filter(some),
                "tf": _lists(tf, pa.int64()).filter(some),
            }

    return map_batches(docs, make, "key long, n long, term array<int>, tf array<long>")


def top_documents(postings: DataFrame, plan: SharingPlan, weights: np.ndarray, rows: int, length: int, k: int) -> DataFrame:
    """``(query, key, score)``: the ``k`` best rows per query and task, by the accumulators of ``plan``.

    Each task carries its best rows along from batch to batch, so it returns ``k`` rows for a query at most.
    """
    small_batches(postings.sparkSession)
    shared = postings.sparkSession.sparkContext.broadcast((plan, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = shared.value
        nodes = plan.terms + len(plan.left)
        # Only nodes that some query needs have an accumulator, but all levels below them do.
        begin = np.append(0, np.cumsum([len(q) for q in plan.queries])).astype(np.int64)
        adds = np.concatenate([np.zeros(0, np.int64), *plan.queries])
        some = np.flatnonzero(np.diff(begin) > 0)
        columns = max(1, CELLS // max(nodes, 1))
        best = {"q": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "none": np.zeros(0, bool), "score": np.zeros(0, np.int64)}
        least = np.ones(len(plan.queries), np.int64)  # score from which a row can still be among the best
        for batch in batches:
            key = batch.column(0)
            keys, none = key.fill_null(0).to_numpy(), ~key.is_valid().to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy()
            edge = batch.column(2).offsets.to_numpy().astype(np.int64)
            first = edge[0]
            term, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            edge = edge - first
            m = 10 + (90 * n * rows) // length
            for lo in range(0, len(n), columns):
                hi = min(lo + columns, len(n))
                a, b = edge[lo], edge[hi]
                doc = np.repeat(np.arange(hi - lo), np.diff(edge[lo:hi + 1]))
                part = weight[term[a:b]] * ((1_000_000_000 * tf[a:b]) // (1000 * tf[a:b] + 8 * m[lo:hi][doc]))
                acc = np.zeros((nodes, hi - lo), np.int64)
                acc[term[a:b], doc] = part
                for now in plan.levels:
                    acc[plan.terms + now] = acc[plan.left[now]] + acc[plan.right[now]]
                if not len(some):
                    continue
                score = np.add.reduceat(acc[adds], begin[:-1][some], axis=0)
                which, d = np.nonzero(score >= least[some, None])
                found = {"q": some[which], "key": keys[lo + d], "none": none[lo + d], "score": score[which, d]}
                best = {c: np.concatenate([best[c], found[c]]) for c in best}
                order = np.lexsort((best["key"], best["none"], -best["score"], best["q"]))
                q = best["q"][order]
                keep = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
                best = {c: v[keep] for c, v in best.items()}
                # Equal scores go on, since their keys may be smaller.
                full = np.bincount(best["q"], minlength=len(least)) >= k
                lowest = np.full(len(least), np.iinfo(np.int64).max)
                np.minimum.at(lowest, best["q"], best["score"])
                least = np.where(full, lowest, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best["q"], pa.int64()), pa.array(best["key"], pa.int64(), mask=best["none"]), pa.array(best["score"], pa.int64())],
            ["query", "key", "score"])

    return postings.mapInArrow(run, "query long, key long, score long")


def rank_documents(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 10
) -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` rows of ``docs`` with the highest score above 0 for each row of ``queries``.

    Terms are runs of letters and digits (every sign beyond ASCII is one) in whole texts, A-Z lower-cased. With N rows that have a term, L terms
    with repeats, n of them in the row, and df rows with a term, a query's score is the sum over its distinct terms of
    floor(1000 ln((2N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 8 m)) with m = 10 + (90 n N div L), in whole numbers.
    Of equal scores the smaller key comes first, rows without a key last. A null or empty text has no terms: such a
    query finds nothing, such a row is not found. Repeated queries are answered each, also those with one id or none; rows with equal keys are
    rows of their own. Keys are whole numbers. Further columns are ignored.

    Queries are evaluated in blocks of about ``BLOCK_TERMS`` terms; each block goes once over all documents.
    """
    asked = stored(queries.select(F.monotonically_increasing_id().alias("_q"), F.col(query_id).alias("_i"), F.col(query_text).alias("_t")), "asked")
    terms_of = stored(query_terms(asked, "_t").filter(F.size("terms") > 0), "query_terms")
    size = terms_of.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_TERMS))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("_t")).filter(F.length("_t") > 0)
    found = None
    for block in range(blocks):
        own = sorted(terms_of.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == block).collect())
        terms = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(r["terms"], np.int64) for r in own)]))
        postings = stored(matches(rows, terms), "matches")
        count, length = postings.agg(F.count("n"), F.sum("n")).first()
        df = np.zeros(len(terms), np.int64)
        for r in postings.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        weights = np.floor(1000 * np.log((2 * count + 2) / (2 * df + 1))).astype(np.int64)
        plan = mine_sharing([np.searchsorted(terms, np.array(r["terms"], np.int64)) for r in own], len(terms))
        best = top_documents(postings.filter(F.size("term") > 0), plan, weights, count, length or 1, k)
        names = docs.sparkSession.createDataFrame([(i, r["_q"]) for i, r in enumerate(own)], "query long, _q long")
        best = best.join(F.broadcast(names), "query").select("_q", "key", "score")
        found = best if found is None else found.unionByName(best)
    place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    top = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.join(asked.select("_q", "_i"), "_q").select(F.col("_i").alias(query_id), "rank", F.col("key").alias(key), "score")
