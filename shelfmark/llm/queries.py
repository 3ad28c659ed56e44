"""The queries of the operators, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import idstore, warc
from shelfmark.llm.decontaminate import contamination
from shelfmark.llm.jaccard import jaccard_components
from shelfmark.llm.language import identify_languages
from shelfmark.llm.language_model import score_texts
from shelfmark.llm.packing import pack_documents
from shelfmark.llm.preference import ordered_turns, preference_turns, stale_replies
from shelfmark.llm.prefix_trie import prefix_trie
from shelfmark.llm.search import search
from shelfmark.llm.secrets import scan_secrets
from shelfmark.llm.sharding import ring_shards
from shelfmark.llm.shared_search import rank_documents
from shelfmark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(_table(spark, folder, "documents"), path, end_id=0, capacity=2048, special=True)


@_query("op2_token_id_store")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "token_ids")
    idstore.write_pages(_table(spark, folder, "documents"), root, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, special=True)
    idstore.build_index(spark, root)
    return idstore.stored_documents(spark, root)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op3_ngram_jaccard_join", rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
sets AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(list_sort(s), '|')) AS same, s FROM shingled),
reps AS (SELECT same, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM sets WHERE n > 0 GROUP BY same),
listed AS (SELECT rep, n, unnest(s) AS x FROM reps),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM listed a JOIN listed b ON a.x = b.x AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
smallest AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, sets.n AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN reps ON sets.n > 0 AND sets.same = reps.same LEFT JOIN smallest ON a = rep""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_table(spark, folder, "documents"), "doc_id", "text", k=3, percent=90).drop("boundary")


@_query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(_table(spark, folder, "documents"))


@_query("op8_benchmark_decontamination", rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width,
         unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS gram
  FROM items WHERE len(w) > 0),
places AS (
  SELECT doc_id, width, unnest(range(1, len(w) - width + 2)) AS pos, w FROM words, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width),
found AS (
  SELECT doc_id, pos, places.width, item_id FROM places JOIN windows ON windows.width = places.width AND gram = array_to_string(w[pos:pos + places.width - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + width)) AS place FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("items")


@_query("op6_consistent_hash_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return ring_shards(_table(spark, folder, "documents"), shards=24)


# A SHA-1 is 40 hexadecimal digits; five of them, 20 bits, are four base-32 signs.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
  (CAST('0x' || substr(sha1(payload), CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '')"""


@_query("op7_zstd_warc", f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
largest AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM payloads)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM largest""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "archives")
    warc.write_archives(_table(spark, folder, "pages"), root)
    return warc.record_digests(warc.read_archives(spark, root))


@_query("op4_exact_top_k_search")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    queries = docs.filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, queries, k=10, query_terms=None, min_docs=1)


@_query("op9_preference_format", """
WITH turns AS (
  SELECT conv_id AS pair_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS nth, role, text
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, nth) AS place FROM turns),
last AS (SELECT pair_id, max(place) AS last FROM placed WHERE role = 'assistant' GROUP BY pair_id),
stale AS (SELECT pair_id, arg_max(text, place) AS stale FROM placed JOIN last USING (pair_id)
          WHERE role = 'assistant' AND place < last GROUP BY pair_id),
kept AS (
  SELECT placed.*, coalesce(place = last, false) AS is_last, coalesce(stale, '') AS stale
  FROM placed LEFT JOIN last USING (pair_id) LEFT JOIN stale USING (pair_id) WHERE last IS NULL OR place <= last),
first AS (SELECT pair_id, min(place) AS first FROM kept WHERE is_last AND text <> stale GROUP BY pair_id),
parts AS (
  SELECT pair_id, CASE WHEN first IS NULL OR place < first THEN 'prompt' ELSE 'chosen' END AS part, turn, nth, role, text
  FROM kept LEFT JOIN first USING (pair_id)
  UNION ALL
  SELECT pair_id, 'rejected', turn, nth, role, CASE WHEN is_last THEN stale ELSE text END
  FROM kept JOIN first USING (pair_id) WHERE place >= first)
SELECT pair_id, part, turn, CAST(nth AS INTEGER) AS nth, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 14 ELSE 0 END AS INTEGER) AS loss_start,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 21 + length(text) ELSE 0 END AS INTEGER) AS loss_end
FROM parts""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    turns = ordered_turns(_table(spark, folder, "conversations"))
    return preference_turns(*stale_replies(turns))


@_query("op10_secret_scan")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(_table(spark, folder, "documents"))


@_query("op11_language_model_score")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(_table(spark, folder, "documents"))


@_query("op12_shared_ranked_search", rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
asked AS (SELECT DISTINCT q, item_id, unnest(w) AS term FROM items),
size AS (SELECT count(*) AS rows, sum(len(w)) AS length FROM words WHERE len(w) > 0),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(rows) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
scored AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * rows) // length)))) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term), size GROUP BY q, item_id, r, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))



# CRC-32 of the decimal digits of a number, half a byte at a time. Its table for four bits.
_CRC_TABLE = [
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]


def _half(state: str) -> str:
    return f"xor(({state}) >> 4, CAST({_CRC_TABLE}[(({state}) & 15) + 1] AS BIGINT))"


_CRC = f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
                           lambda c, b: {_half(_half('xor(c, b)'))}), 4294967295::BIGINT)"""


@_query("op13_conversation_prefix_trie", rf"""
WITH said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS nth, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS said,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS size, {_CRC} % 4 AS h FROM said GROUP BY conv_id),
taken AS (
  SELECT c.conv_id, c.h, least(c.h, coalesce(d.size, 0)) AS taken FROM convs c LEFT JOIN convs d ON d.conv_id = c.conv_id - c.conv_id % 20),
steps AS (
  SELECT conv_id, nth - h + taken AS depth, said, words FROM said JOIN taken USING (conv_id) WHERE nth > h
  UNION ALL SELECT t.conv_id, nth, said, words FROM taken t JOIN said s ON s.conv_id = t.conv_id - t.conv_id % 20 AND nth <= h
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
paths AS (
  SELECT conv_id, depth, words, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, max(depth) OVER (PARTITION BY conv_id) AS total FROM steps),
nodes AS (
  SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = total) AS ends FROM paths GROUP BY path),
family AS (
  SELECT p.path, p.conv_id, count(*) AS n_children FROM nodes p JOIN nodes c ON c.depth = p.depth + 1 AND starts_with(c.path, p.path) GROUP BY p.path, p.conv_id),
below AS (
  SELECT x.path, sum((y.n_convs - 1) * y.words) AS saved, count(*) FILTER (WHERE f.path IS NULL) AS leaves
  FROM nodes x JOIN nodes y ON starts_with(y.path, x.path) LEFT JOIN family f ON f.path = y.path GROUP BY x.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below USING (path) LEFT JOIN family f ON f.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(_table(spark, folder, "conversations"))
