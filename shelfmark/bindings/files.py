"""Sources and sinks: tables written to fresh scratch folders and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.bindings.registry import Tables, day, query
from shelfmark.bindings.texts import SQL_SEPARATORS
from shelfmark.functions import text as X
from shelfmark.operators.aggregate import rating_distribution
from shelfmark.operators.project import exploded
from shelfmark.session import scratch_path
from shelfmark.sinks import writers as W
from shelfmark.sources import readers as S


@query("read_catalog_csv", """
SELECT p_partkey, p_name || chr(10) || '"' || p_brand || '", x' AS name,
       CASE WHEN p_brand <> 'Brand#2' THEN p_brand END AS brand,
       CASE WHEN p_type = 'SMALL' THEN 'na' WHEN p_type NOT IN ('ECONOMY', 'LARGE', 'PROMO') THEN p_type END AS type,
       p_retailprice
FROM part""")
def read_catalog_csv(t: Tables) -> DataFrame:
    # The second half has its columns in another order.
    kind = F.col("p_type")
    texts = t.part.select(
        "p_partkey",
        F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", x')).alias("name"),
        F.when(F.col("p_brand") == "Brand#2", "N/A").otherwise(F.col("p_brand")).alias("brand"),
        F.when(kind == "ECONOMY", "NULL").when(kind == "LARGE", "None").when(kind == "PROMO", "")
        .when(kind == "SMALL", "na").otherwise(kind).alias("type"),
        "p_retailprice",
    )
    paths = [scratch_path(t.spark, "catalog_csv") for _ in range(2)]
    for i, path in enumerate(paths):
        half = texts.filter(F.col("p_partkey") % 2 == i).select(texts.columns[::1 - 2 * i])
        half.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return S.read_catalog_csv(t.spark, paths, texts.schema)


@query("read_csv_multi_infer", """
SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS status, CAST(o_orderdate AS DATE) AS order_date
FROM orders""")
def read_csv_multi_infer(t: Tables) -> DataFrame:
    paths = [scratch_path(t.spark, "orders_csv") for _ in range(2)]
    status = F.col("o_orderstatus")
    texts = t.orders.select(
        "o_orderkey", "o_totalprice", F.when(status == "P", "NA").otherwise(status).alias("status"),
        day("o_orderdate").alias("order_date"),
    )
    for i, path in enumerate(paths):
        half = texts.filter(F.col("o_orderkey") % 2 == i).select(texts.columns[::1 - 2 * i])
        W.write_csv_chunked(half, path, chunk_size=4000)
    read = S.read_csv_multi(t.spark, paths, infer=True).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))
    return read.select("o_orderkey", "o_totalprice", "status", "order_date")


@query("read_ndjson", "SELECT conv_id, turn, role, text FROM conversations")
def read_ndjson(t: Tables) -> DataFrame:
    path = W.write_ndjson(t.conversations, scratch_path(t.spark, "conversations_ndjson"))
    return S.read_ndjson(t.spark, path, t.conversations.schema).drop(S.CORRUPT)


ELEMENTS = """
SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, unnest(embedding) AS value FROM embeddings"""


@query("read_features_parquet", ELEMENTS)
def read_features_parquet(t: Tables) -> DataFrame:
    vectors = S.read_features_parquet(t.spark, t.path("embeddings"))
    return vectors.select("vec_id", "label", F.posexplode("embedding").alias("dim", "value"))


@query("read_stopwords", f"""
SELECT DISTINCT lang, word FROM (
  SELECT lang, unnest(regexp_split_to_array(lower(text), '{SQL_SEPARATORS}')) AS word FROM documents)
WHERE word <> ''""")
def read_stopwords(t: Tables) -> DataFrame:
    # One list per language: all its words.
    words = exploded(t.documents, ["lang"], X.split_tokens(F.col("text")), "word")
    path = scratch_path(t.spark, "word_lists")
    words.distinct().write.partitionBy("lang").text(path)
    return S.read_stopwords(t.spark, path)


@query("write_csv_chunked", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS ship_date
FROM lineitem""")
def write_csv_chunked(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
        day("l_shipdate").alias("ship_date"),
    )
    path = W.write_csv_chunked(lines, scratch_path(t.spark, "lines_csv"))
    return S.read_csv_multi(t.spark, path, lines.schema)


@query("write_csv_quoteall_sorted", """
SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS priority,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status
FROM orders""")
def write_csv_quoteall_sorted(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", "o_totalprice",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    path = scratch_path(t.spark, "orders_sorted_csv")
    W.write_csv_quoteall_sorted(rows, path, "o_totalprice", "o_orderkey")
    read = S.read_csv_multi(t.spark, path, rows.schema)
    return read.withColumn("status", F.coalesce("status", F.lit("")))


@query("write_result_csv", """
SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS rating_group, count(*) AS count
FROM lineitem WHERE l_quantity >= 10 GROUP BY 1""")
def write_result_csv(t: Tables) -> DataFrame:
    scored = t.lineitem.select("l_quantity", (F.col("l_quantity") / 5).alias("score"))
    report = rating_distribution(scored, "l_quantity", "score", 10)
    path = W.write_result_csv(report, scratch_path(t.spark, "report_csv"), single_file=True)
    return S.read_csv_multi(t.spark, path, report.schema)


@query("write_ndjson", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events""")
def write_ndjson(t: Tables) -> DataFrame:
    rows = t.events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    path = W.write_ndjson(rows, scratch_path(t.spark, "events_ndjson"))
    return S.read_ndjson(t.spark, path, rows.schema).drop(S.CORRUPT)


@query("write_features_parquet", ELEMENTS)
def write_features_parquet(t: Tables) -> DataFrame:
    path = W.write_features_parquet(t.embeddings, scratch_path(t.spark, "vectors"))
    return S.read_features_parquet(t.spark, path).select("vec_id", "label", F.posexplode("embedding").alias("dim", "value"))
