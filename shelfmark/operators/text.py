"""Text operators: token filtering, cleaning, vocabulary, TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.functions.wordlists import ANALYSIS_STOPWORDS
from shelfmark.operators.aggregate import count_by, word_counts
from shelfmark.operators.project import exploded
from shelfmark.operators.relate import broadcast_if_bounded
from shelfmark.operators.vocabulary import most_frequent
from shelfmark.schema import VOCABULARY_SIZE
from shelfmark.session import scratch_path


def token_filter(df: DataFrame, text: str, out: str, stopwords: Sequence[str]) -> DataFrame:
    """Add ``out``: the tokens of ``text`` that no rule rejects, joined by a blank."""
    return df.withColumn(out, X.filtered_text(F.col(text), stopwords))


def token_rule_audit(df: DataFrame, text: str, stopwords: Sequence[str]) -> DataFrame:
    """How many tokens each rule rejects, and how many are kept.

    Tokens are counted before the rules run, so each distinct token is judged once.
    """
    tokens = exploded(df, [], X.split_tokens(F.col(text)), "token")
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    judged = counted.select(X.token_rule(F.col("token"), stopwords).alias("rule"), "_n")
    return judged.groupBy("rule").agg(F.sum("_n").alias("tokens"))


def clean_alpha(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: lower-case ASCII words of ``text`` between single blanks."""
    return df.withColumn(out, X.clean_alpha(F.col(text)))


def tokenize(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the lower-case words of ``text``."""
    return df.withColumn(out, X.words(F.col(text)))


def remove_stopwords(
    df: DataFrame, words: str, out: str, stopwords: Sequence[str] | None = None
) -> DataFrame:
    """Add ``out``: ``words`` without stopwords, by default Spark ML's English ones."""
    stop = ANALYSIS_STOPWORDS if stopwords is None else stopwords
    return df.withColumn(out, X.without_stopwords(F.col(words), stop))


def analysed_words(
    df: DataFrame, text: str, out: str, stopwords: Sequence[str] | None = None
) -> DataFrame:
    """Clean, drop blank texts, tokenise and drop stopwords: the word array the analyses start from.

    Blank texts are found on the raw text, since a filter on the cleaned one would clean it twice.
    """
    stop = ANALYSIS_STOPWORDS if stopwords is None else stopwords
    filled = df.filter(X.has_word(F.col(text)))
    return filled.withColumn(
        out, F.filter(X.clean_words(F.col(text)), lambda w: ~w.isin(*[s.lower() for s in stop]))
    )


def top_vocabulary(df: DataFrame, words: str, size: int = VOCABULARY_SIZE) -> DataFrame:
    """The most frequent words with their counts, by bounded summaries of tasks (runs jobs); ties go to the smaller word."""
    return most_frequent(df, F.col(words), None, size).select("word", "count")


def _term_runs(df: DataFrame, words: str, *keep: str) -> DataFrame:
    """``keep`` and ``runs``, the distinct words of a row with their counts, written once to the scratch folder.

    Cleaning the texts is the costly part; what needs the words twice reads them from here.
    """
    path = scratch_path(df.sparkSession, "term_runs")
    df.select(*keep, X.term_runs(F.col(words)).alias("runs")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _vocabulary_statistics(runs: DataFrame, size: int) -> DataFrame:
    """``(word, count, doc_freq, idf)`` of the ``size`` most frequent words of the rows of ``_term_runs``; ``idf`` counts all but null ones."""
    rows = F.lit(float(runs.filter("runs IS NOT NULL").count() + 1))
    top = most_frequent(runs, F.col("runs.word"), F.col("runs.tf"), size)
    return top.withColumn("idf", F.log(rows / (F.col("doc_freq") + 1)))


def term_frequencies(
    df: DataFrame, key: str, words: str, size: int = VOCABULARY_SIZE
) -> DataFrame:
    """How often each vocabulary word occurs in each row: ``(key, word, tf)``.

    Rows are counted in place, once; only the vocabulary needs a shuffle, bounded by the tasks' summaries. One of more than 100,000
    words is not broadcast but joined by its words, where Spark does not find it small.
    """
    runs = _term_runs(df, words, key)
    vocab = _vocabulary_statistics(runs, size).select("word")
    counted = runs.select(key, F.inline("runs")).join(broadcast_if_bounded(vocab, size), "word")
    return counted.select(key, "word", "tf")


def tfidf(df: DataFrame, key: str, words: str, size: int = VOCABULARY_SIZE) -> DataFrame:
    """TF-IDF of each vocabulary word in each row: tf x ln((rows + 1) / (rows with the word + 1))."""
    runs = _term_runs(df, words, key)
    vocab = _vocabulary_statistics(runs, size).select("word", "idf")
    weighted = runs.select(key, F.inline("runs")).join(broadcast_if_bounded(vocab, size), "word")
    return weighted.select(key, "word", (F.col("tf") * F.col("idf")).alias("tfidf"))


def top_tfidf_terms(
    df: DataFrame, words: str, k: int = VOCABULARY_SIZE, size: int = VOCABULARY_SIZE
) -> DataFrame:
    """Vocabulary words by summed TF-IDF.

    A word has one idf, so its sum is count x idf and no per-row table is needed.
    """
    scored = _vocabulary_statistics(_term_runs(df, words), size).select(
        "word", (F.col("count") * F.col("idf")).alias("tfidf_sum")
    )
    return scored.orderBy(F.desc("tfidf_sum"), "word").limit(k)


def frequent_words(
    df: DataFrame, text: str, size: int = VOCABULARY_SIZE, stopwords: Sequence[str] | None = None
) -> DataFrame:
    """``(word, count)`` of the most frequent words of a text column.

    The same words as ``analysed_words``, exploded before the stopwords are dropped, so that all but
    the cleaning runs in generated code.
    """
    stop = ANALYSIS_STOPWORDS if stopwords is None else stopwords
    words = exploded(df, [], X.clean_words(F.col(text)), "word")
    kept = words.filter((F.col("word") != "") & ~F.col("word").isin(*[w.lower() for w in stop]))
    return count_by(kept, ["word"]).limit(size)


def term_vectors(
    df: DataFrame, words: str, out: str, vocabulary: Sequence[str] | None = None, size: int = VOCABULARY_SIZE
) -> tuple[DataFrame, CountVectorizerModel]:
    """Sparse count vectors for Spark ML, over a given vocabulary or one fitted here (runs jobs)."""
    if vocabulary is not None:
        model = CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol=words, outputCol=out)
    else:
        model = CountVectorizer(inputCol=words, outputCol=out, vocabSize=size).fit(df)
    return model.transform(df), model


def tfidf_vectors(df: DataFrame, counts: str, out: str) -> DataFrame:
    """Count vectors weighted by Spark ML's IDF (runs a job)."""
    return IDF(inputCol=counts, outputCol=out).fit(df).transform(df)
