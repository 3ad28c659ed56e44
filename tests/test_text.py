"""Text rules against plain Python on small texts."""

import math
import re
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.functions.wordlists import ANALYSIS_STOPWORDS, ENGLISH_STOPWORDS
from shelfmark.operators import relate as R
from shelfmark.operators import text as O
from shelfmark.operators import vocabulary as V

PATTERNS = [r"[a-zA-Z]*\d+[a-zA-Z]*", r"[a-zA-Z0-9]*[^\w\s][a-zA-Z0-9]*"]


def kept(token, stop):
    """Whether a lower-cased token survives, by Python's own regexes."""
    if len(token) <= 2 or token.isdigit() or token in stop:
        return False
    return not any(re.fullmatch(p, token) for p in PATTERNS)


def filtered(text, stop):
    return " ".join(t for t in (w.lower() for w in re.split(r"[,\s]+", text)) if kept(t, stop))


def run(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("v"))).collect()]


DROPPED = ["life.", "don't", "sci-fi", "1970s", "12pm", "100ft", "ab", "the", "abc123", "2000", "²²²", "_9", "(x"]
KEPT = ["well-known.", "u.s.", "---", "4x4", "café.", "13½", "word", "naïve", "40ºc", "4n413742"]


def test_token_examples(spark):
    got = run(spark, lambda c: X.filtered_text(c, ENGLISH_STOPWORDS), [*DROPPED, *KEPT])
    assert got == [""] * len(DROPPED) + KEPT


def test_number_list_leaves_four(spark):
    tokens = "00,007,02pm,101barz,13½,14pm,1900s,22am,3dsmax,3po,40ºc,46ers,4n,4n413742,4x4,66min,733ad,99"
    assert run(spark, lambda c: X.filtered_text(c, []), [tokens]) == ["13½ 40ºc 4n413742 4x4"]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("aZé½²ª٣9,. _-'\t\n  \x1f́世", max_size=24), min_size=1, max_size=30))
def test_token_filter_equals_python(spark, texts):
    stop = {"aa", "zzz"}
    assert run(spark, lambda c: X.filtered_text(c, sorted(stop)), texts) == [filtered(t, stop) for t in texts]


def test_separators_are_pythons(spark):
    spaces = [chr(c) for c in range(sys.maxunicode + 1) if re.match(r"[,\s]", chr(c))]
    texts = [f"a{c}b" for c in spaces]
    assert run(spark, X.split_tokens, texts) == [["a", "b"]] * len(texts)


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(None,), ("a word",)], "v string")
    rows = O.token_filter(df, "v", "p", ENGLISH_STOPWORDS).collect()
    assert {(r.v, r.p) for r in rows} == {(None, None), ("a word", "word")}


def test_rule_audit_names_the_first_rule(spark):
    df = spark.createDataFrame([("ab 123 ²²² abc1 life. the word word",)], "v string")
    got = {r.rule: r.tokens for r in O.token_rule_audit(df, "v", ["the"]).collect()}
    assert got == {"short_or_digit": 3, "alnum": 1, "special": 1, "stopword": 1, "keep": 2}


def test_audit_keeps_what_the_filter_keeps(spark):
    tokens = spark.createDataFrame([(t,) for t in [*DROPPED, *KEPT]], "v string")
    rows = tokens.select(
        (X.token_rule(F.col("v"), ENGLISH_STOPWORDS) == X.KEEP).alias("a"),
        X.keep_token(F.col("v"), ENGLISH_STOPWORDS).alias("b"),
    ).collect()
    assert all(r.a == r.b for r in rows)


def test_clean_alpha(spark):
    texts = [" Hello,  World! ", "don't\tstop\n\nNOW", "123 --", "", None, "é a\x0bb"]
    assert run(spark, X.clean_alpha, texts) == ["hello world", "dont stop now", "", "", None, "a b"]
    assert run(spark, X.has_word, texts) == [True, True, False, False, None, True]


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("aBé9 \t\n\r\x0b\x0c-", max_size=20), min_size=1, max_size=30))
def test_clean_alpha_equals_python(spark, texts):
    want = [" ".join(re.sub(r"[^a-z \t\n\r\x0b\x0c]", "", t.lower()).split()) for t in texts]
    assert run(spark, X.clean_alpha, texts) == want
    assert run(spark, X.has_word, texts) == [w != "" for w in want]


def test_words(spark):
    assert run(spark, X.words, [" A  b\tC ", "", None]) == [["a", "b", "c"], [], None]


@pytest.mark.parametrize("stop", [None, ["b"]])
def test_remove_stopwords(spark, stop):
    df = spark.createDataFrame([(["the", "B", "zebra"],), (None,)], "w array<string>")
    got = O.remove_stopwords(df, "w", "o", stop).collect()
    assert [r.o for r in got] == [["B", "zebra"] if stop is None else ["the", "zebra"], None]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=30), min_size=1, max_size=10))
def test_term_runs_count_words(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "k int, w array<string>")
    got = [r[0] for r in df.orderBy("k").select(X.term_runs(F.col("w"))).collect()]
    assert [{e.word: e.tf for e in runs} for runs in got] == [dict(Counter(d)) for d in docs]
    assert all(len(runs) == len(set(d)) for runs, d in zip(got, docs))


DOCS = [["x", "y", "x"], ["y"], ["z", "x"], [], ["w", "w", "w", "z"]]


def documents(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "k int, w array<string>")


def brute_tfidf(size):
    counts = Counter(w for d in DOCS for w in d)
    vocab = sorted(counts, key=lambda w: (-counts[w], w))[:size]
    idf = {w: math.log((len(DOCS) + 1) / (sum(w in d for d in DOCS) + 1)) for w in vocab}
    return {(k, w): d.count(w) * idf[w] for k, d in enumerate(DOCS) for w in vocab if w in d}


@pytest.mark.parametrize("size", [2, 4, 10])
def test_tfidf_equals_brute_force(spark, size):
    got = {(r.k, r.word): r.tfidf for r in O.tfidf(documents(spark), "k", "w", size).collect()}
    assert got == pytest.approx(brute_tfidf(size))
    sums = Counter()
    for (_, w), v in brute_tfidf(size).items():
        sums[w] += v
    top = {r.word: r.tfidf_sum for r in O.top_tfidf_terms(documents(spark), "w", size=size).collect()}
    assert top == pytest.approx(dict(sums))


def test_tfidf_rows_without_words_count_but_null_rows_do_not(spark):
    df = documents(spark).union(spark.createDataFrame([(9, None)], "k int, w array<string>"))
    got = {(r.k, r.word): r.tfidf for r in O.tfidf(df, "k", "w", 4).collect()}
    assert got == pytest.approx(brute_tfidf(4))


def zipf(spark, rows, parts):
    """Rows of words by falling frequency, with ties, single words and nulls."""
    rng = np.random.default_rng(4)
    texts = [[*(f"w{int(x) % 3000}" for x in rng.zipf(1.3, 30)), f"only{i}", None] for i in range(rows)]
    return texts, spark.createDataFrame(list(enumerate([*texts, [], None])), "k int, w array<string>").repartition(parts)


def by_count(texts, size):
    counts, docs = Counter(), Counter()
    for t in texts:
        kept = [w for w in t if w is not None]
        counts.update(kept)
        docs.update(set(kept))
    return [(w, counts[w], docs[w]) for w in sorted(counts, key=lambda w: (-counts[w], w))[:size]]


@pytest.mark.parametrize("size, counters", [(20, None), (20, 600), (20, 25), (400, 30), (50, 1)])
def test_most_frequent_with_few_counters(spark, size, counters):
    # None left out; some left out and candidates counted again; too many left out, so all are counted.
    texts, df = zipf(spark, 700, 5)
    df = df.select(X.term_runs(F.col("w")).alias("r"))
    got = V.most_frequent(df, F.col("r.word"), F.col("r.tf"), size, counters)
    assert [tuple(r) for r in got.collect()] == by_count(texts, size)


@pytest.mark.parametrize("counters", [None, 600])
def test_most_frequent_without_counts(spark, counters):
    texts, df = zipf(spark, 300, 3)
    got = V.most_frequent(df, F.col("w"), None, 15, counters).collect()
    assert [(r.word, r["count"]) for r in got] == [t[:2] for t in by_count(texts, 15)]
    assert V.most_frequent(df.limit(0), F.col("w"), None, 15).collect() == []
    with pytest.raises(ValueError, match="at least one word"):
        V.most_frequent(df, F.col("w"), None, 0)


def test_tasks_pass_on_no_more_than_their_counters(spark, monkeypatch, tmp_path):
    _, df = zipf(spark, 700, 5)
    monkeypatch.setattr(V, "scratch_path", lambda _, label: f"{tmp_path}/{label}")
    V.most_frequent(df, F.col("w"), None, 20, 600)
    passed = spark.read.parquet(f"{tmp_path}/words").groupBy(F.input_file_name().alias("f")).agg(F.count("word").alias("n"), F.max("missed").alias("missed"))
    assert {r.n for r in passed.collect()} == {600} and all(r.missed >= 1 for r in passed.collect())
    assert spark.read.parquet(f"{tmp_path}/candidates").count() < 600


def test_memory_of_a_summary_does_not_follow_its_rows(spark):
    import pyarrow as pa

    summary, most = V._summary(V.COUNTERS), 0
    before = pa.total_allocated_bytes()

    def batches():
        nonlocal most
        for i in range(80):
            words = pa.array([[f"word {i} {row} {j}" for j in range(100)] for row in range(100)])
            yield pa.RecordBatch.from_arrays([words], ["w"])
            most = max(most, pa.total_allocated_bytes() - before)

    rows = sum(b.num_rows for b in summary(batches()))
    assert rows == V.COUNTERS + 1 and most < 10 << 20
    V.most_frequent(zipf(spark, 50, 2)[1], F.col("w"), None, 5)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(V.BATCH_ROWS)


@pytest.mark.parametrize("size", [7, 100, 5000])
def test_vocabularies_too_large_for_one_task(spark, monkeypatch, size):
    monkeypatch.setattr(V, "MAX_VOCABULARY", 5)
    monkeypatch.setattr(R, "MAX_BROADCAST_ROWS", 5)
    texts, df = zipf(spark, 200, 4)
    assert sorted(tuple(r) for r in O.top_vocabulary(df, "w", size).collect()) == sorted(t[:2] for t in by_count(texts, size))
    vocab = {w for w, *_ in by_count(texts, size)}
    want = {(k, w): n for k, t in enumerate(texts) for w, n in Counter(t).items() if w in vocab}
    frequencies = O.term_frequencies(df, "k", "w", size)
    assert {(r.k, r.word): r.tf for r in frequencies.collect()} == want


def test_ml_vectors_agree_with_the_long_form(spark):
    df = documents(spark)
    vocab = [r.word for r in O.top_vocabulary(df, "w", 4).collect()]
    assert vocab == ["w", "x", "y", "z"]
    counted, _ = O.term_vectors(df, "w", "tf", vocab)
    weighted = O.tfidf_vectors(counted, "tf", "tfidf").select("k", vector_to_array("tfidf").alias("v"))
    got = {(r.k, w): v for r in weighted.collect() for w, v in zip(vocab, r.v) if v}
    assert got == pytest.approx({key: v for key, v in brute_tfidf(4).items() if v})
    fitted, model = O.term_vectors(df, "w", "tf", size=4)
    assert sorted(model.vocabulary) == sorted(vocab) and fitted.count() == len(DOCS)


def test_term_frequencies_are_limited_to_the_vocabulary(spark):
    got = {(r.k, r.word): r.tf for r in O.term_frequencies(documents(spark), "k", "w", 2).collect()}
    assert got == {(0, "x"): 2, (2, "x"): 1, (4, "w"): 3}


def test_frequent_words_equal_the_array_route(spark):
    texts = [("The cat, the hat.",), ("Don't HAT 123",), (None,), ("...",)]
    df = spark.createDataFrame(texts, "t string")
    fast = O.frequent_words(df, "t", 10)
    arrays = O.top_vocabulary(O.analysed_words(df, "t", "w"), "w", 10)
    assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in arrays.collect()]
    assert [tuple(r) for r in fast.collect()] == [("hat", 2), ("cat", 1), ("dont", 1)]


def test_stopword_lists(spark):
    assert len(ENGLISH_STOPWORDS) == len(set(ENGLISH_STOPWORDS)) == 198
    assert len(ANALYSIS_STOPWORDS) == 181
    assert StopWordsRemover.loadDefaultStopWords("english") == ANALYSIS_STOPWORDS
