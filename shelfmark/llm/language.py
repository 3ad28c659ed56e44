"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every training text, per language, into ``FEATURES`` hashed counters. Each task
sums its own texts, then the tasks' sums are added in two rounds; only languages x ``FEATURES`` numbers reach the
driver. The matrix of log probabilities, of that same fixed size, is broadcast, and texts are scored in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import forget_kept, slices, sum_arrays
from shelfmark.llm.words import groups_by_size

FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
UNKNOWN = "und"
MIN_FIT = -0.55  # between other prose of a learned language (about -0.45) and random letters (about -0.6)
_CHUNK = 1 << 20
_SCORED = 1 << 18  # letters scored at once: each has a row of the matrix
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order up to three, hashed n-grams of the texts and where those of each text begin (one more entry for the end); letters per text.

    Texts are lower-cased; runs of other characters than letters are one blank, and each text begins and ends
    with one, so n-grams see where words begin and end. An n-gram does not cross a blank inside.
    """
    joined = "\0".join(texts).lower()
    if joined.count("\0") != len(texts) - 1:
        joined = "\0".join(t.replace("\0", " ") for t in texts).lower()
    codes = np.frombuffer(("\0" + joined + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _LETTER[codes]
    keep = letter.copy()
    ends = codes == 0
    keep[1:] |= letter[:-1] | ends[1:]
    keep[0] = True
    edges = np.append(np.cumsum(keep)[ends] - 1, keep.sum())  # where the blank before each text stands
    letter = letter[keep]
    values = np.where(letter, codes[keep], np.uint32(32)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    letters = np.add.reduceat(letter.astype(np.int64), edges[:-1])[:len(texts)]
    # One letter; two signs, not both blank; three with a letter in the middle.
    uses = [letter, letter[:-1] | letter[1:], letter[1:-1]]
    found, h = [], values
    for order, use in enumerate(uses, 1):
        if order > 1:
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + values[order - 1:]
        at = np.flatnonzero(use)
        x = h[at]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        found.append(((x >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), np.searchsorted(at, edges[:-1])))
    return found, letters


def _chunks(column: pa.Array, size: int = _CHUNK):
    texts = ["" if t is None else t for t in column.to_pylist()]
    for lo, hi in groups_by_size(np.array([len(t) for t in texts], dtype=np.int64), size):
        yield lo, hi, texts[lo:hi]


@dataclass
class LanguageModel:
    """Languages in order, and for each the log probability of every feature and of the language.

    ``usual`` is the mean log probability of an n-gram of the language's own texts, ``strange`` that of any feature.
    """

    languages: list[str]
    log_probability: np.ndarray
    log_prior: np.ndarray
    usual: np.ndarray
    strange: np.ndarray


def train(docs: DataFrame, text: str, lang: str, smoothing: float = 0.5) -> LanguageModel:
    """Model from all rows of ``docs`` with a text and a language; without any, a model without languages."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lo, hi, texts in _chunks(batch.column(0)):
                found, _ = grams(texts)
                for name in set(langs[lo:hi]):
                    of = langs[lo:hi] == name
                    total = sums.setdefault(name, np.zeros(FEATURES + 1, dtype=np.int64))
                    total[-1] += int(of.sum())
                    for features, begins in found:
                        total[:-1] += np.bincount(features[np.repeat(of, np.diff(begins))], minlength=FEATURES)
        for name, total in sums.items():
            for number, salt, part in slices(total, TaskContext.get().partitionId()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([part], pa.binary())],
                    ["lang", "slice", "salt", "counts"])

    usable = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    sums = sum_arrays(usable.mapInArrow(make, "lang string, slice int, salt int, counts binary"), "lang", FEATURES + 1)
    names = sorted(sums)
    counts = np.array([sums[n][:-1] for n in names], dtype=float).reshape(len(names), FEATURES)
    rows = np.array([sums[n][-1] for n in names], dtype=float)
    smooth = counts + smoothing
    log_probability = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
    usual = (counts * log_probability).sum(axis=1) / np.maximum(counts.sum(axis=1), 1)
    return LanguageModel(names, log_probability, np.log(rows / max(rows.sum(), 1)), usual, log_probability.mean(axis=1, dtype=np.float64))


def predict(docs: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred``, ``score``, the posterior probability of the predicted language, and ``fit``.

    ``fit`` says how far the text's n-grams are from those of the language's own texts: about 0 for these, about -1 for n-grams the
    language does not have, less an allowance of one over the root of their number, so that few n-grams weigh little; it is 0 at
    most. A text without letters and a null one are ``und`` with score and fit 0, as is every text for a model without languages. Ties
    go to the first language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names, at = [*docs.columns, "lang_pred", "score", "fit"], docs.columns.index(text)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        m = shared.value
        table = np.ascontiguousarray(m.log_probability.T)
        for batch in batches:
            label = np.full(batch.num_rows, UNKNOWN, dtype=object)
            score, fit = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo, hi, texts in _chunks(batch.column(at), _SCORED):
                found, letters = grams(texts)
                some = np.flatnonzero(letters > 0)
                if not len(some) or not m.languages:
                    continue
                # A text with a letter has n-grams of every order up to two; absent ones get an empty sum.
                evidence, number = np.tile(m.log_prior, (len(some), 1)), np.zeros(len(some))
                for features, begins in found:
                    sizes = np.diff(begins)[some]
                    sums = np.add.reduceat(table[features], begins[:-1][some[sizes > 0]], axis=0, dtype=np.float64)
                    evidence[sizes > 0] += sums
                    number += sizes
                best = evidence.argmax(axis=1)
                scaled = evidence - evidence.max(axis=1, keepdims=True)
                posterior = np.exp(scaled)
                label[lo + some] = np.array(m.languages, dtype=object)[best]
                score[lo + some] = posterior[np.arange(len(some)), best] / posterior.sum(axis=1)
                mean = (evidence[np.arange(len(some)), best] - m.log_prior[best]) / number
                away = (m.usual - mean[:, None])[np.arange(len(some)), best] / np.maximum(m.usual - m.strange, 1e-9)[best]
                fit[lo + some] = np.minimum(1 / np.sqrt(number) - away, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score), pa.array(fit)], names)

    return docs.mapInArrow(make, f"{schema}, lang_pred string, score double, fit double")


def held_out(key: str, folds: int = 5):
    """Whether the CRC-32 of the key, as text, leaves no rest."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """``(key, held_out, lang_pred, score)`` for every row; the model learns from rows that are not held out.

    Rows without a key are not held out. Further columns are ignored; without a training row every prediction is ``und``.
    """
    split = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).alias("_l"),
                        F.coalesce(held_out(key, folds), F.lit(False)).alias("held_out"))
    model = train(split.filter(~F.col("held_out")), "_t", "_l")
    said = predict(split.select("_k", "held_out", "_t"), "_t", model)
    return said.select(F.col("_k").alias(key), "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, text: str = "text", lang: str = "lang", min_score: float = 0.5, min_fit: float = MIN_FIT) -> DataFrame:
    """The rows of ``docs`` whose text has a recognisable language, by a model learned from all of them.

    Rejected are texts without letters, null texts, those whose best language has a probability below ``min_score``, and those whose
    n-grams are too far from that language's own texts (``fit`` below ``min_fit``): strings of random letters and languages in
    other letters. An unlearned language that shares letters and endings with a learned one stays, as would other prose of a learned
    one. Without any row to learn from nothing can be judged, and rows with a letter stay.
    """
    model = train(docs.select(F.col(text).alias("_t"), F.col(lang).cast("string").alias("_l")), "_t", "_l")
    if not model.languages:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    judged = predict(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_t")), "_t", model)
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & (F.col("fit") >= min_fit)
    return judged.filter(known).select("_row.*")
