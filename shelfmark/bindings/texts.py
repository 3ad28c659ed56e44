"""Text operators on the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.bindings.registry import Tables, query, rounded, sql_list
from shelfmark.functions import text as X
from shelfmark.functions.wordlists import ANALYSIS_STOPWORDS, ENGLISH_STOPWORDS
from shelfmark.operators import text as O
from shelfmark.operators.aggregate import word_counts
from shelfmark.schema import VOCABULARY_SIZE


# The separators of a token, written out for a regex engine whose ``\\s`` is ASCII only.
_SPACES = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SQL_SEPARATORS = f"[,{_SPACES}]+"
_CLEANED = r"""trim(regexp_replace(
  regexp_replace(lower(text), '[^a-zA-Z\x09-\x0d ]', '', 'g'), '[\x09-\x0d ]+', ' ', 'g'))"""
_STOP = sql_list(ENGLISH_STOPWORDS)
WORDS = f"""
cleaned AS (SELECT doc_id, {_CLEANED} AS cleaned_text FROM documents),
words AS (
  SELECT doc_id, unnest(string_split(cleaned_text, ' ')) AS word FROM cleaned WHERE cleaned_text <> '')"""
KEPT_WORDS = f"""{WORDS},
kept AS (SELECT doc_id, word FROM words WHERE word NOT IN ({sql_list(ANALYSIS_STOPWORDS)}))"""
_TERMS = f"""{KEPT_WORDS},
vocab AS (SELECT word, count(*) AS count FROM kept GROUP BY word ORDER BY count(*) DESC, word LIMIT {VOCABULARY_SIZE}),
tf AS (
  SELECT doc_id, word, count(*) AS tf FROM kept WHERE word IN (SELECT word FROM vocab) GROUP BY doc_id, word)"""
_TFIDF = f"""{_TERMS},
total AS (SELECT count(*) AS m FROM cleaned WHERE cleaned_text <> ''),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
weighted AS (
  SELECT doc_id, word, tf * ln(CAST(m + 1 AS DOUBLE) / (df + 1)) AS tfidf FROM tf JOIN df USING (word), total)"""

# The token rules, written out here and not taken from the operators.
_DIGITS = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
_RULE = f"""CASE
  WHEN length(t) < 3 OR regexp_full_match(t, '[{_DIGITS}]+') THEN 'short_or_digit'
  WHEN regexp_full_match(t, '[a-zA-Z]*\\p{{Nd}}+[a-zA-Z]*') THEN 'alnum'
  WHEN regexp_full_match(t, '\\p{{Nd}}+[a-zA-Z]+') THEN 'unit'
  WHEN regexp_full_match(t, '\\p{{Nd}}{{1,2}}(am|pm)') THEN 'clock'
  WHEN regexp_full_match(t, '\\p{{Nd}}+') THEN 'number'
  WHEN regexp_full_match(t, '[a-zA-Z0-9]*[^\\p{{L}}\\p{{N}}_\\s][a-zA-Z0-9]*') THEN 'special'
  WHEN t IN ({_STOP}) THEN 'stopword' ELSE 'keep' END"""
PROCESSED = f"""array_to_string(list_filter(
  regexp_split_to_array(lower(text), '{SQL_SEPARATORS}'), lambda t: {_RULE} = 'keep'), ' ')"""


def document_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text")


def document_words(t: Tables) -> DataFrame:
    """Documents with their cleaned words."""
    cleaned = O.clean_alpha(document_texts(t), "text", "cleaned_text")
    return O.tokenize(cleaned, "cleaned_text", "words").select("doc_id", "words")


def analysed(t: Tables) -> DataFrame:
    """Non-blank documents with their words less the default stopwords."""
    return O.analysed_words(document_texts(t), "text", "words").select("doc_id", "words")


@query("token_filter", f"SELECT doc_id, {PROCESSED} AS processed_text FROM documents")
def token_filter(t: Tables) -> DataFrame:
    filtered = O.token_filter(document_texts(t), "text", "processed_text", ENGLISH_STOPWORDS)
    return filtered.select("doc_id", "processed_text")


@query("token_rule_audit", f"""
WITH tokens AS (SELECT unnest(regexp_split_to_array(lower(text), '{SQL_SEPARATORS}')) AS t FROM documents)
SELECT {_RULE} AS rule, count(*) AS tokens
FROM tokens GROUP BY 1""")
def token_rule_audit(t: Tables) -> DataFrame:
    return O.token_rule_audit(document_texts(t), "text", ENGLISH_STOPWORDS)


@query("clean_alpha", f"SELECT doc_id, {_CLEANED} AS cleaned_text FROM documents")
def clean_alpha(t: Tables) -> DataFrame:
    return O.clean_alpha(document_texts(t), "text", "cleaned_text").select("doc_id", "cleaned_text")


@query("tokenize", f"WITH {WORDS} SELECT word, count(*) AS count FROM words GROUP BY word")
def tokenize(t: Tables) -> DataFrame:
    return word_counts(document_words(t), "words")


@query("remove_stopwords", f"""
WITH {KEPT_WORDS},
lists AS (SELECT doc_id, list(word ORDER BY word) AS kept FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(lists.kept, ' '), '') AS kept FROM documents LEFT JOIN lists USING (doc_id)""")
def remove_stopwords(t: Tables) -> DataFrame:
    # The words themselves, in alphabetical order.
    kept = O.remove_stopwords(document_words(t), "words", "kept")
    return kept.select("doc_id", F.array_join(F.array_sort("kept"), " ").alias("kept"))


@query("word_counts", f"WITH {KEPT_WORDS} SELECT word, count(*) AS count FROM kept GROUP BY word")
def count_words(t: Tables) -> DataFrame:
    return word_counts(analysed(t), "words")


@query("top_vocabulary", f"""
WITH {WORDS}
SELECT word, count(*) AS count FROM words GROUP BY word ORDER BY count(*) DESC, word LIMIT {VOCABULARY_SIZE}""")
def top_vocabulary(t: Tables) -> DataFrame:
    return O.top_vocabulary(document_words(t), "words")


@query("term_frequency_vectors", f"WITH {_TERMS} SELECT doc_id, word, tf FROM tf")
def term_frequencies(t: Tables) -> DataFrame:
    return O.term_frequencies(analysed(t), "doc_id", "words")


@query("tfidf", f"WITH {_TFIDF} SELECT doc_id, word, round(tfidf, 6) AS tfidf FROM weighted")
def tfidf(t: Tables) -> DataFrame:
    weighted = O.tfidf(analysed(t), "doc_id", "words")
    return weighted.withColumn("tfidf", rounded("tfidf"))


@query("frequent_words", f"WITH {_TERMS} SELECT word, count FROM vocab")
def frequent_words(t: Tables) -> DataFrame:
    return O.frequent_words(document_texts(t), "text")


@query("top_tfidf_terms", f"""
WITH {_TFIDF}
SELECT word, round(sum(tfidf), 4) AS tfidf_sum FROM weighted GROUP BY word
ORDER BY sum(tfidf) DESC, word LIMIT 50""")
def top_tfidf_terms(t: Tables) -> DataFrame:
    top = O.top_tfidf_terms(analysed(t), "words", k=50)
    return top.withColumn("tfidf_sum", rounded("tfidf_sum", 4))
