"""Secrets in texts: candidates by pattern, false ones removed by a random forest.

A candidate is a run of at least ``MIN_LENGTH`` letters, digits and ``+/=_-``, without a name and '=' before it; or, also shorter and with other
signs, the value that a name for a secret is assigned; or a key of a known format or what follows "Bearer". The forest judges it by its length, the
kinds of its characters and the changes between them, how well its letter pairs fit the corpus, how much of it the
corpus's own words cover, path marks, and the words and signs around it. It is trained on labelled findings, of
which a bounded number per label is taken. Words and letter pairs are counted over all texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, slices, stored, sum_arrays
from shelfmark.llm.words import LOWER, SYMBOLS, groups_by_size, raw_text, words

MIN_LENGTH = 16
DICTIONARY_WORDS = 4096
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/=_-]{{{MIN_LENGTH},}}")
_PART = re.compile(r"[A-Za-z0-9+/_-]+=*")
_SCHEME = r"(?:bearer|basic|token)\s+"
_NAMED = re.compile(
    rf"(?:token|key|secret|(?P<pass>password|passwd|pwd)|auth|credential)\w*[\"']?\s*[:=]\s*(?:{_SCHEME})?(?!{_SCHEME})"
    r"(?:\"(?P<a>[!#-~]{6,})\"|'(?P<b>[!-&(-~]{6,})'|[\"']?(?P<c>[A-Za-z0-9+/=_.!@#$%^*~-]{6,}))", re.I)
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}"
    r"|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9])")
_BEARER = re.compile(r"\bbearer\s+([A-Za-z0-9+/_.~-]{16,}=*)", re.I)
_MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9!@#$%^*~+])")
_LONG_RUN = re.compile(rf"[A-Za-z0-9+/=_-]{{{MIN_LENGTH},}}")
#: Words that often stand beside a secret, and words that often stand beside other long strings.
SECRET_WORDS = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "credential", "bearer", "private", "access")
OTHER_WORDS = ("sha", "commit", "hash", "checksum", "md5", "digest", "uuid", "revision", "example", "http", "https", "www")
_CHUNK = 1 << 22
_PAIRS = 27 * 27
MASK = "[SECRET]"
UNCERTAIN = 0.4  # a finding without a label where there is no forest


def corpus_statistics(docs: DataFrame, text: str) -> tuple[frozenset[str], np.ndarray]:
    """The most frequent words of 3 to 8 ASCII letters (ties: the alphabet), and log probabilities of letter pairs, over all texts.

    ``DICTIONARY_WORDS`` words and 729 numbers reach the driver.
    """
    letters = np.full(256, 0, dtype=np.int64)
    letters[97:123] = np.arange(1, 27)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(_PAIRS, dtype=np.int64)
        for batch in batches:
            buf, off = raw_text(batch.column(0))
            for lo, hi in groups_by_size(np.diff(off), _CHUNK):
                span = off[lo:hi + 1]
                part = LOWER[buf[span[0]:span[-1]]]
                code = letters[part]
                pairs += np.bincount(code[:-1] * 27 + code[1:], minlength=_PAIRS)
                start, length, _, _ = words(part, span - span[0], SYMBOLS)
                short = (length >= 3) & (length <= 8)
                start, length = start[short], length[short]
                packed, plain = np.zeros(len(start), dtype=np.int64), np.ones(len(start), dtype=bool)
                for i in range(8):
                    use = length > i
                    own = part[np.minimum(start + i, len(part) - 1)]
                    plain &= ~use | (letters[own] > 0)
                    packed = packed * 128 + np.where(use, own, 0)
                value, count = np.unique(packed[plain], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(value), pa.array(count), pa.nulls(len(value), pa.int32()), pa.nulls(len(value), pa.int32()), pa.nulls(len(value), pa.binary())], names)
        for number, salt, part in slices(pairs, TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([part], pa.binary())], names)

    names = ["word", "n", "slice", "salt", "counts"]
    made = stored(docs.select(text).mapInArrow(make, "word long, n long, slice int, salt int, counts binary"), "words")
    total = made.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    top = total.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()
    known = frozenset("".join(chr(r["word"] >> 7 * (7 - i) & 127) for i in range(8)).rstrip("\0") for r in top)
    counts = sum_arrays(made.filter("slice IS NOT NULL").select(F.lit("all").alias("of"), "slice", "salt", "counts"), "of", _PAIRS)
    pairs = counts.get("all", np.zeros(_PAIRS, dtype=np.int64)).reshape(27, 27) + 0.5
    return known, np.log(pairs / pairs.sum(axis=1, keepdims=True))


def coverage(word: str, known: frozenset[str]) -> float:
    """Share of the word's signs that known words cover, longest first from the left."""
    low, at, held = word.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(8, len(low) - at), 2, -1) if low[at:at + n] in known), 0)
        held += n
        at += n or 1
    return held / len(word)


def features(candidate: str, before: str, after: str, source: str | None, known: frozenset[str], pairs: np.ndarray) -> list[float]:
    """What the forest sees of a candidate and the text around it."""
    b = np.frombuffer(candidate.encode("ascii"), dtype=np.uint8)
    n = len(b)
    kind = np.select([(b >= 48) & (b <= 57), (b >= 97) & (b <= 122), (b >= 65) & (b <= 90)], [0, 1, 2], 3)
    share = np.bincount(kind, minlength=4) / n
    counts = np.bincount(b)
    p = counts[counts > 0] / n
    code = np.where((LOWER[b] >= 97) & (LOWER[b] <= 122), LOWER[b].astype(np.int64) - 96, 0)
    near_before = [w.lower() for w in re.findall(r"\w+", before)[-3:]]
    near_after = [w.lower() for w in re.findall(r"\w+", after)[:2]]
    return [
        float(n), *share.tolist(), float((kind[1:] != kind[:-1]).mean()), float(-(p * np.log2(p)).sum()),
        float(pairs[code[:-1], code[1:]].mean()), float(np.isin(b, np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)).mean()),
        coverage(candidate, known),
        float(candidate.count("/")), float(before[-1:] in ("/", "\\", ".", "@")), float(sum(map(ord, source or "")) % 16),
        float(sum(any(s in w for s in SECRET_WORDS) for w in near_before)), float(sum(w in OTHER_WORDS for w in near_before + near_after)),
        float(before[-1:] in ("'", '"', "`")), float(after[:1] in ("'", '"', "`")), float(bool(re.search(r"[:=]\s*[\"'`]?$", before[-8:]))),
    ]


def spans(t: str) -> list[tuple[int, int, bool | None, bool]]:
    """``(start, stop, label, known)`` of the candidates of a text, in order and apart from each other.

    ``known``: by its form or after "Bearer" it is a secret. ``label`` is None where it is not certain: a run of mixed signs without a name, or a
    plain word that a name is assigned.
    """
    found: list[tuple[int, int, bool | None, bool]] = [(*m.span(), True, True) for m in _KNOWN.finditer(t)]
    if "earer" in t or "EARER" in t:
        found += [(*m.span(1), True, True) for m in _BEARER.finditer(t) if _MIXED.match(m[1])]
    if "=" in t or ":" in t:
        for m in _NAMED.finditer(t):
            kind = next(g for g in "abc" if m[g] is not None)
            a, b = m.span(kind)
            if kind == "c":  # the end of a sentence is no part of a value without quotes
                b = a + len(m[kind].rstrip(".!"))
            value = t[a:b]
            sure = _LONG_RUN.fullmatch(value) or _MIXED.match(value) or kind != "c" and m["pass"]
            if len(value) >= 6:
                found.append((a, b, True if sure else None, False))
    for m in _CANDIDATE.finditer(t):
        if "=" not in m.group():
            parts = [m.span()]
        else:
            parts = [(m.start() + x.start(), m.start() + x.end()) for x in _PART.finditer(m.group())]
            # The name before a sign of assignment is no candidate with that sign; a run of such signs only stays one.
            parts = [(a, b if b == m.end() else a + len(t[a:b].rstrip("="))) for a, b in parts] or [m.span()]
        found += [(a, b, unassigned(t[a:b], t[max(0, a - 60):a]), False) for a, b in parts if b - a >= MIN_LENGTH]
    # Those listed first go before others that they overlap.
    out: list[tuple[int, int, bool | None, bool]] = []
    for x in found:
        i = bisect_left(out, x[:2], key=lambda y: y[:2])
        if (i == 0 or out[i - 1][1] <= x[0]) and (i == len(out) or x[1] <= out[i][0]):
            out.insert(i, x)
    return out


def unassigned(candidate: str, before: str) -> bool | None:
    """Label of a candidate that no name for a secret is assigned: False for plain words (also several in a name), numbers, paths, repeated signs and named hashes, else None."""
    near = [w.lower() for w in re.findall(r"\w+", before)[-3:]]
    plain = all(not w or w.isupper() or w.isalpha() and w[1:] == w[1:].lower() for w in re.split("[_-]", candidate)) and not re.search("[0-9+/=]", candidate)
    plain = plain or not re.search("[A-Za-z]", candidate)
    return False if plain or candidate.count("/") > 1 or len(set(candidate)) < 6 or any(w in OTHER_WORDS for w in near) else None


def candidates(docs: DataFrame, key: str, text: str, source: str, known: frozenset[str], pairs: np.ndarray) -> DataFrame:
    """``(key, row_hash, start, stop, candidate, label, known, features)``: every candidate of every whole text.

    ``row_hash`` is that of the text; ``label`` and ``known`` are those of ``spans``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, pairs))  # fixed size
    kind = docs.schema[key].dataType.simpleString()

    def make(batch: pa.RecordBatch):
        words_known, table = shared.value
        at, out = [], []
        for i, value in enumerate(batch.column(1)):
            t = value.as_py() or ""
            for a, b, label, known in spans(t):
                before, after = t[max(0, a - 60):a], t[b:b + 40]
                at.append(i)
                out.append((a, b, t[a:b], label, known, features(t[a:b], before, after, batch.column(2)[i].as_py(), words_known, table)))
            if len(at) > 20_000:
                yield columns(batch, at, out)
                at, out = [], []
        if at:
            yield columns(batch, at, out)

    def columns(batch, at, out):
        rows = pa.array(at)
        start, stop, found, label, known, values = zip(*out)
        return {key: batch.column(0).take(rows), "row_hash": batch.column(3).take(rows), "start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32()),
                "candidate": pa.array(found), "label": pa.array(label, pa.bool_()), "known": pa.array(known), "features": pa.array(values, pa.list_(pa.float64()))}

    rows = docs.select(key, text, F.col(source).cast("string"), F.xxhash64(text).alias("row_hash"))
    return map_batches(rows, make, f"{key} {kind}, row_hash long, start int, stop int, candidate string, label boolean, known boolean, features array<double>")


def train(labelled: DataFrame, most: int = 20_000, trees: int = 32, depth: int = 8, seed: int = 7):
    """Forest from rows ``(features, label)``; at most ``most`` of each label, those with the smallest hashes. None without both labels.

    The bounded sample is put in one order in one partition, so the forest does not depend on how it was spread.
    """
    sample = None
    for label in (0.0, 1.0):
        own = labelled.filter(F.col("label") == label).dropDuplicates(["features"]).orderBy(F.xxhash64("features"), "features").limit(most)
        sample = own if sample is None else sample.union(own)
    sample = stored(sample.select(array_to_vector("features").alias("features"), "label", F.xxhash64("features").alias("h")).coalesce(1).sortWithinPartitions("h"), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(sample.coalesce(1).sortWithinPartitions("h"))


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", labelled: DataFrame | None = None, threshold: float = 0.5
) -> DataFrame:
    """``(key, row_hash, start, stop, candidate, probability, is_secret)``: every candidate in every text, judged.

    ``labelled`` has findings as ``(features, label)``. Without it, the findings of the texts themselves are labelled: positive
    if a name for a secret is assigned the candidate, or if it is known by its form or "Bearer"; negative if it is a plain word, a number, a path or
    the like; others are judged but train nothing. If findings of only one label exist, there is no forest and each finding keeps
    its own label, as probability 1 or 0, or ``UNCERTAIN``. What is known by its form is a secret whatever the forest says. Null and empty texts have no candidate. Positions count signs from 0; ``stop``
    is behind the last one. Rows with equal or null keys are scanned each for itself. Further columns are ignored.
    """
    own = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(source).alias("_s"))
    known, pairs = corpus_statistics(own, "_t")
    found = stored(candidates(own, "_k", "_t", "_s", known, pairs), "candidates")
    if labelled is None:
        labelled = found.select("features", F.col("label").cast("double").alias("label")).filter("label IS NOT NULL")
    forest = train(labelled)
    if forest is None:
        judged = found.withColumn("probability", F.coalesce(F.col("label").cast("double"), F.lit(UNCERTAIN)))
    else:
        scored = forest.transform(found.withColumnRenamed("features", "_f").withColumn("features", array_to_vector("_f")))
        judged = scored.withColumn("probability", F.round(F.get(vector_to_array("probability"), 1), 6))
    judged = judged.withColumn("probability", F.when(F.col("known"), 1.0).otherwise(F.col("probability")))
    return judged.select(
        F.col("_k").alias(key), "row_hash", "start", "stop", "candidate", "probability", (F.col("probability") >= threshold).alias("is_secret")
    )


def mask_secrets(docs: DataFrame, findings: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret of ``findings`` replaced by ``MASK``, and ``length``, if named, brought up to date.

    Findings belong to a text by its hash, so all copies of a text are masked alike; a text's own findings are
    merged before the join. Texts without a secret stay as they are.
    """
    spans = findings.filter("is_secret").groupBy("row_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop", "candidate"))).alias("__spans")
    )
    spans = stored(spans.withColumnRenamed("row_hash", "__hash"), "spans")
    joined = docs.withColumn("__hash", F.xxhash64(text)).join(spans, "__hash", "left")
    # From the last span to the first, so that earlier positions stay valid.
    masked = F.aggregate(
        F.reverse("__spans"), F.col(text),
        lambda t, s: F.when(
            F.substring(t, s["start"] + 1, s["stop"] - s["start"]) == s["candidate"],
            F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(MASK), F.substring(t, s["stop"] + 1, F.length(t))),
        ).otherwise(t),
    )
    changed = F.col("__spans").isNotNull()
    out = joined.withColumn(text, F.when(changed, masked).otherwise(F.col(text)))
    if length in docs.columns:
        out = out.withColumn(length, F.when(changed, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(docs.columns)
