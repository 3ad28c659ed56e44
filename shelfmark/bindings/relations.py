"""Joins, de-duplication and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.bindings.registry import Tables, query, sql_list
from shelfmark.bindings.texts import KEPT_WORDS, SQL_SEPARATORS, WORDS, analysed, document_words
from shelfmark.functions import text as X
from shelfmark.functions.wordlists import ENGLISH_STOPWORDS
from shelfmark.operators import relate as J
from shelfmark.operators.aggregate import word_counts
from shelfmark.operators.dedup import dedup_by_id, dedup_keep_first
from shelfmark.operators.project import exploded
from shelfmark.operators.rank import sort_by_score
from shelfmark.plans.harvest import merge_daily, merge_increment
from shelfmark.session import scratch_path
from shelfmark.sinks.keyed import KeyedTable


@query("left_join_cluster_label", """
SELECT doc_id, lang, label FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def left_join_cluster_label(t: Tables) -> DataFrame:
    labels = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    return J.left_join_unique(t.documents.select("doc_id", "lang"), labels, "doc_id")


def labelled_metadata(t: Tables) -> DataFrame:
    """Clustered rows with the bucket and the tags of their document."""
    meta = t.documents.select(
        F.col("doc_id").alias("vec_id"),
        F.floor(F.col("n_chars") / 1000).alias("bucket"),
        F.concat_ws(", ", "lang", "source").alias("tags"),
    )
    return J.left_join_unique(t.embeddings.select("vec_id", "label"), meta, "vec_id")


@query("left_join_metadata", """
SELECT vec_id, label, CAST(floor(n_chars / 1000) AS BIGINT) AS bucket, lang || ', ' || source AS tags
FROM embeddings LEFT JOIN documents ON vec_id = doc_id""")
def left_join_metadata(t: Tables) -> DataFrame:
    return labelled_metadata(t)


@query("semi_join_vocab", f"""
WITH {KEPT_WORDS},
vocab AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '{SQL_SEPARATORS}')) AS word FROM benchmark)
SELECT word, count(*) AS count FROM kept WHERE word IN (SELECT word FROM vocab) GROUP BY word""")
def semi_join_vocab(t: Tables) -> DataFrame:
    counts = word_counts(analysed(t), "words")
    vocab = exploded(t.benchmark, [], X.split_tokens(F.col("text")), "word")
    return J.semi_join_vocab(counts, vocab)


@query("anti_join_stopwords", f"""
WITH {WORDS}
SELECT word, count(*) AS count FROM words WHERE word NOT IN ({sql_list(ENGLISH_STOPWORDS)}) GROUP BY word""")
def anti_join_stopwords(t: Tables) -> DataFrame:
    # Counted first: the list is then met once per distinct word.
    counts = word_counts(document_words(t), "words")
    return J.anti_join_stopwords(counts, ENGLISH_STOPWORDS)


@query("anti_join_pending", """
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def anti_join_pending(t: Tables) -> DataFrame:
    return J.anti_join_pending(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id")


@query("semi_join_available", """
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def semi_join_available(t: Tables) -> DataFrame:
    return J.semi_join_available(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id")


@query("embedding_or_zero", """
SELECT doc_id, CAST(unnest(range(64)) AS INTEGER) AS dim,
       unnest(coalesce(embedding, list_transform(range(64), lambda x: CAST(0 AS FLOAT)))) AS value
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def embedding_or_zero(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    filled = J.embedding_or_zero(t.documents.select("doc_id"), vectors, "doc_id", "embedding", 64)
    return filled.select("doc_id", F.posexplode("embedding").alias("dim", "value"))


@query("id_frontier", """
SELECT id FROM (SELECT unnest(range((SELECT max(c_custkey) + 1 FROM customer),
                                    (SELECT max(o_orderkey) + 1 FROM orders))) AS id)
WHERE id NOT IN (SELECT l_orderkey FROM lineitem)""")
def id_frontier(t: Tables) -> DataFrame:
    # Held: the ids of the customers. Latest: the highest order. Done already: orders with lines.
    held = t.customer.select(F.col("c_custkey").alias("id"))
    latest = t.orders.agg(F.max("o_orderkey")).first()[0]
    return J.id_frontier(held, "id", latest, t.lineitem.select(F.col("l_orderkey").alias("id")))


@query("missing_ids", """
SELECT id FROM (SELECT unnest(range(1, (SELECT max(o_orderkey) + 1 FROM orders))) AS id)
WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 3 AND o_orderkey % 1000 > 40) AND id NOT IN (SELECT c_custkey FROM customer)""")
def missing_orders(t: Tables) -> DataFrame:
    # Held: orders with gaps, short and long ones. Done already: the ids of the customers.
    key = F.col("o_orderkey")
    held = t.orders.filter((key % 7 != 3) & (key % 1000 > 40)).select(key.alias("id"))
    latest = t.orders.agg(F.max("o_orderkey")).first()[0]
    return J.missing_ids(held, "id", 1, latest, t.customer.select(F.col("c_custkey").alias("id")))


@query("dedup_keep_first", """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS pos FROM documents)
WHERE pos = 1""")
def dedup_copies(t: Tables) -> DataFrame:
    return dedup_keep_first(t.documents, ["text"], [F.desc("n_chars"), F.asc("doc_id")])


@query("dedup_by_id", """
SELECT user_id, event_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
WHERE pos = 1""")
def dedup_users(t: Tables) -> DataFrame:
    first = dedup_by_id(t.events, "user_id", [F.asc("ts"), F.asc("event_id")])
    return first.select("user_id", "event_id", "event_type", "value", "props")


@query("union_by_name", """
SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders
UNION ALL
SELECT o_orderkey, o_totalprice, NULL, o_orderpriority FROM orders""")
def union_by_name(t: Tables) -> DataFrame:
    return J.union_by_name(
        t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"),
        t.orders.select("o_orderpriority", "o_totalprice", "o_orderkey"),
    )


_MERGED = """
SELECT o_orderkey,
       CASE WHEN o_orderstatus <> 'F' THEN o_totalprice + 1 WHEN o_orderkey % 3 = 0 THEN o_totalprice + 7 ELSE o_totalprice END AS score,
       o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS o_orderpriority
FROM orders"""


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pending orders are in both halves; the new half has a raised score and no priority. A third of the old half
    is there twice, once with a raised score."""
    status = F.col("o_orderstatus")
    old = t.orders.filter(status != "O").select(
        "o_orderkey", F.col("o_totalprice").alias("score"), "o_orderstatus", "o_orderpriority"
    )
    again = old.filter("o_orderkey % 3 = 0").withColumn("score", F.col("score") + 7)
    new = t.orders.filter(status != "F").select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("score"), "o_orderstatus"
    )
    return old.union(again), new


@query("merge_daily", _MERGED)
def merge_orders(t: Tables) -> DataFrame:
    return merge_daily(*_halves(t), "o_orderkey", "score")


@query("merge_increment", _MERGED)
def merge_orders_stored(t: Tables) -> DataFrame:
    # The same by a stored catalogue: the old half is loaded, the new one merged into it.
    old, new = _halves(t)
    table = KeyedTable(t.spark, scratch_path(t.spark, "catalogue"), old.schema, "o_orderkey", "score", bucket_rows=20_000)
    merge_increment(table, old, "old")
    merge_increment(table, new.withColumn("o_orderpriority", F.lit(None).cast("string")), "new")
    return sort_by_score(table.read(), "score", "o_orderkey")
