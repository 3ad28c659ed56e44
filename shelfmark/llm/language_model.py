"""Language-model scores of texts by online logistic context mixing, learned from the corpus itself.

One pass over the training texts counts, in every task, the distinct histories of a byte and the distinct words. From the histories come
the counts of 0 and 1 in hashed slots for each kind of context; the tasks' tables are added slice by slice over the executors, and
each slot is reduced to a state of two bytes where its slice is. Only these, of fixed size, and the words of the highest counts, a
bounded number, reach the driver and are broadcast. Words beyond that number are looked up by a join. A second pass over the training texts learns
the gates' weights from sums of fixed size, a third one scores all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import mixing
from shelfmark.llm.common import small_batches, stored
from shelfmark.llm.mixing import Mixer
from shelfmark.llm.sums import PARTS, SLICE_BYTES, gathered, merged, pack, sliced, unpack
from shelfmark.llm.words import groups_by_size, raw_text

KNOWN_WORDS = 1 << 20  # words whose counts are broadcast
PRIOR = 100.0  # decisions for which the weights that the gates start with stand
_CHUNK = 1 << 22
_SCORED = 1 << 21
_HELD_HISTORIES = 1 << 22
_HELD_WORDS = 1 << 20
_BUCKETS = 16  # per power of two of a word's count


def _normal_chunks(column: pa.Array, size: int = _CHUNK):
    """For runs of texts: first row, one after the last, the bytes that stand for them, and their bounds."""
    buf, off = raw_text(column)
    for lo, hi in groups_by_size(np.diff(off), size):
        span = off[lo:hi + 1]
        yield lo, hi, *mixing.normal_form(buf[span[0]:span[-1]], span - span[0])


class _Counts:
    """Counts of distinct numbers, added bit by bit."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, numbers: np.ndarray) -> None:
        numbers, counts = np.unique(numbers, return_counts=True)
        self.parts.append((numbers, counts.astype(np.int32)))
        self.size += len(self.parts[-1][0])

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            numbers = np.concatenate([n for n, _ in self.parts])
            order = np.argsort(numbers, kind="stable")  # merges the parts, which are sorted
            numbers, counts = numbers[order], np.concatenate([c for _, c in self.parts])[order]
            first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])[:len(numbers)])
            self.parts = [(numbers[first], np.add.reduceat(counts, first) if len(first) else counts)]
        self.size = sum(len(n) for n, _ in self.parts)
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def clear(self) -> None:
        self.parts, self.size = [], 0


def count_corpus(texts: DataFrame, bits: tuple[int, ...]) -> DataFrame:
    """Rows ``PARTS`` of every task: tables ``c0``, ``c1``, .. of counted decisions, ``words`` (hashes, then counts), and ``texts``, whose slice is the
    number of texts."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, said, rows = _Counts(), _Counts(), 0

        def tables() -> Iterator[pa.RecordBatch]:
            histories, counts = seen.merge()
            if len(histories):
                for i, table in enumerate(mixing.count_bits(histories, counts, bits)):
                    yield from sliced(f"c{i}", table, "<i8")
            seen.clear()

        def row(name: str, number: int, data: bytes) -> pa.RecordBatch:
            task = TaskContext.get().partitionId()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int32()), pa.array([task], pa.int32()), pa.array([data], pa.binary())],
                                              ["name", "slice", "task", "data"])

        def words() -> Iterator[pa.RecordBatch]:
            hashes, counts = said.merge()
            for lo in range(0, len(hashes), 1 << 16):
                part = np.concatenate([hashes[lo:lo + (1 << 16)], counts[lo:lo + (1 << 16)]])
                yield row("words", lo >> 16, pack(part))
            said.clear()

        for batch in batches:
            rows += batch.num_rows
            for _, _, b, _ in _normal_chunks(batch.column(0)):
                history, hashes, _ = mixing.histories(b)
                seen.add(history)
                said.add(hashes)
                if seen.size > 2 * _HELD_HISTORIES and len(seen.merge()[0]) > _HELD_HISTORIES:
                    yield from tables()
                if said.size > 2 * _HELD_WORDS and len(said.merge()[0]) > _HELD_WORDS:
                    yield from words()
        yield from tables()
        yield from words()
        yield row("texts", rows, b"")

    return stored(texts.mapInArrow(run, PARTS), "corpus_counts")


def corpus_mixer(parts: DataFrame, bits: tuple[int, ...]) -> Mixer:
    """States of all slots and logits of all states, from the counts of the whole corpus."""
    tables = [np.zeros(1 << size, np.uint16) for size in bits]
    met = np.zeros((len(bits), 2, mixing._PAIRS))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, number, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                counts = unpack(data, "<i8")
                zeros, ones = counts[0::2], counts[1::2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(name[1:])], pa.int32()), pa.array([number], pa.int32()), pa.array([pack(mixing.state_of(zeros, ones))], pa.binary()),
                     pa.array([pack(mixing.without_one(zeros, ones))], pa.binary())], ["kind", "slice", "states", "met"])

    sums = merged(parts.filter(F.col("name").startswith("c")), "<i8")
    width = SLICE_BYTES // 16
    for r in sums.mapInArrow(reduce, "kind int, slice int, states binary, met binary").toLocalIterator():
        states = unpack(r["states"], "<u2")
        tables[r["kind"]][r["slice"] * width:r["slice"] * width + len(states)] = states
        met[r["kind"]] += unpack(r["met"], "<f8").reshape(2, -1)
    return Mixer(tables, [mixing.logits_of(m) for m in met])


def word_counts(parts: DataFrame) -> DataFrame:
    """``(hash, n)`` of all words of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                both = unpack(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(both[:len(both) // 2]), pa.array(both[len(both) // 2:])], ["hash", "n"])

    rows = parts.filter("name = 'words'").select("data").mapInArrow(run, "hash long, n long")
    return stored(rows.groupBy("hash").agg(F.sum("n").alias("n")), "word_counts")


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of all words above a count that at most ``most`` words reach."""
    bucket = F.floor(F.log2("n") * _BUCKETS)
    least, words = 0, 0
    for r in sorted(counts.groupBy(bucket.alias("b")).count().collect(), reverse=True):
        words += r["count"]
        if words > most:
            least = r["b"] + 1
            break
    table = counts.filter(bucket >= least).toArrow()
    hashes, n = (table.column(c).to_numpy() for c in ("hash", "n"))
    order = np.argsort(hashes)
    return hashes[order], n[order]


def shared_tables(spark: SparkSession, mixer: Mixer) -> Broadcast:
    """The tables and logits, compressed, as one broadcast for all passes; ``opened`` makes a mixer of it in a task."""
    return spark.sparkContext.broadcast(([pack(t) for t in mixer.tables], [pack(x) for x in mixer.logits]))


def opened(shared: Broadcast) -> Mixer:
    tables, logits = shared.value
    return Mixer([unpack(t, "<u2") for t in tables], [unpack(x, "<f4") for x in logits])


def learn_gates(texts: DataFrame, mixer: Mixer, shared: Broadcast, number: int, prior: float = PRIOR) -> None:
    """Weights of the gates, learned from all ``number`` texts by one Newton step from those the mixer has.

    Each task adds slope and curvature over its texts, the tasks' sums are added over the executors. So the weights do not depend on how rows
    are dealt. Repeated texts count each time.
    """
    if not number:
        return
    small_batches(texts.sparkSession)
    shapes = {name: (len(getattr(mixer, name)), width + 1, width) for name, width in mixing.GATES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(shared)
        seen, sums = _Counts(), {name: np.zeros(shape) for name, shape in shapes.items()}
        for batch in batches:
            for _, _, b, _ in _normal_chunks(batch.column(0)):
                seen.add(mixing.histories(b)[0])
                if seen.size > 2 * _HELD_HISTORIES and len(seen.merge()[0]) > _HELD_HISTORIES:
                    mixing.gate_sums(own, *seen.merge(), sums)
                    seen.clear()
        mixing.gate_sums(own, *seen.merge(), sums)
        for name, total in sums.items():
            yield from sliced(name, total.ravel(), "<f8")

    parts = stored(texts.mapInArrow(run, PARTS), "gates")
    total = gathered(merged(parts, "<f8"), "<f8", {name: int(np.prod(shape)) for name, shape in shapes.items()})
    for name, shape in shapes.items():
        setattr(mixer, name, mixing.moved(getattr(mixer, name), total[name].reshape(shape), prior))


def _per_text(text_of: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(text_of, weights=values, minlength=texts)


def score_rows(rows: DataFrame, mixer: Mixer, shared: Broadcast, known: tuple[np.ndarray, np.ndarray], ends: int, tokens: int, kinds: int) -> DataFrame:
    """Scores of ``rows`` (``_id``, ``_t`` and others): tokens, those known, base score but for rare words, natural log probability, bytes, and
    the rare words with their occurrences."""
    frequent = rows.sparkSession.sparkContext.broadcast(known)
    weights = {name: getattr(mixer, name) for name in mixing.GATES}
    small_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c != "_t"]
    at = [rows.columns.index(c) for c in kept]
    text_at = rows.columns.index("_t")
    names = [*kept, "n_tokens", "n_known", "base", "ln", "bytes", "hash", "tf"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = mixing.Probabilities(replace(opened(shared), **weights))
        words, counts = frequent.value
        for batch in batches:
            for lo, hi, b, off in _normal_chunks(batch.column(text_at), _SCORED):
                texts = hi - lo
                history, hashes, where = mixing.histories(b)
                ln = mixing.text_scores(probabilities, history, off)
                text_of = np.repeat(np.arange(texts), np.diff(np.searchsorted(where, off)))
                distinct, place = mixing.numbered(hashes)
                found = np.minimum(np.searchsorted(words, distinct), max(len(words) - 1, 0))
                held = words[found] == distinct if len(words) else np.zeros(len(distinct), bool)
                worth = np.zeros(len(distinct))
                worth[held] = np.log10((counts[found[held]] + 0.1) / (tokens + 0.1 * (kinds + 1)))
                known_here = _per_text(text_of, held[place], texts).astype(np.int64)
                said = np.bincount(text_of, minlength=texts)
                rare = np.flatnonzero(~held[place])
                pair, tf = np.unique(text_of[rare] * np.int64(len(distinct)) + place[rare], return_counts=True)
                edge = np.searchsorted(pair, np.arange(texts + 1) * np.int64(max(len(distinct), 1))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(v, pa.int64())) for v in (distinct[pair % max(len(distinct), 1)], tf)]
                base = _per_text(text_of, worth[place], texts) + log10((ends + 0.1) / (tokens + 0.1 * (kinds + 1)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, texts) for i in at), pa.array(said + 1), pa.array(known_here + (ends > 0)), pa.array(base), pa.array(ln),
                     pa.array(np.diff(off)), *lists], names)

    return rows.mapInArrow(run, f"{schema}, n_tokens long, n_known long, base double, ln double, bytes long, hash array<long>, tf array<long>")


def score_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, bits: tuple[int, ...] = mixing.BITS,
    known_words: int = KNOWN_WORDS,
) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for every row.

    Learned from the rows that are not held out, which are those whose CRC-32 of the key, as text, leaves a rest by ``folds``. Tokens are the words between
    blanks, with A-Z lower-cased, and one end mark. ``base_score`` is the log10 probability by single tokens, ``score`` that of the whole
    text by the mixed model, ``bits_per_byte`` the same in bits for each byte of the words, the blanks between them and the end mark.
    A null or empty text is its end mark alone. A row without a key is not held out. Repeated rows count each time; further columns
    are ignored. Without any training row every decision is even, and so is the base.

    ``bits`` bounds the tables, whatever the corpus; the ``known_words`` most frequent words are broadcast, all others joined.
    """
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("_id"), F.col(key).alias("_k"), held.alias("held_out"), F.col(text).alias("_t"))
    training = rows.filter(~F.col("held_out")).select("_t")
    parts = count_corpus(training, bits)
    ends = parts.filter("name = 'texts'").agg(F.sum(F.col("slice").cast("long"))).first()[0] or 0
    counts = word_counts(parts)
    said, kinds = counts.agg(F.sum("n"), F.count("n")).first()
    tokens, kinds = (said or 0) + ends, kinds + (ends > 0)
    mixer = corpus_mixer(parts, bits)
    shared = shared_tables(docs.sparkSession, mixer)
    learn_gates(training, mixer, shared, ends)
    known = frequent_words(counts, known_words)
    scored = stored(score_rows(rows, mixer, shared, known, ends, tokens, kinds), "scored")

    rare = scored.filter(F.size("hash") > 0).select("_id", F.inline(F.arrays_zip("hash", "tf")))
    n = F.coalesce("n", F.lit(0))
    more = rare.join(counts, "hash", "left").groupBy("_id").agg(
        F.sum(F.col("tf") * F.log10((n + 0.1) / F.lit(tokens + 0.1 * (kinds + 1)))).alias("more"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("met"))
    score = F.col("ln") / log(10)
    return scored.drop("hash", "tf").join(more, "_id", "left").select(
        F.col("_k").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score * (log(10) / log(2)) / F.col("bytes")).alias("bits_per_byte"))
