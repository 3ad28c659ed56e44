"""Projections and filters on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.bindings.registry import Tables, query
from shelfmark.functions.columns import TITLE_CHARS
from shelfmark.operators import filters as L
from shelfmark.operators import project as P
from shelfmark.operators.text import clean_alpha
from shelfmark.schema import KEYWORD_DOC, MISSING_DATE, SENTINELS

BASE = "https://img.example.org/w780"
LINE_KEY = ["l_orderkey", "l_linenumber"]


def orders_with_lines(t: Tables) -> DataFrame:
    """Orders with their lines; orders without lines have nulls."""
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")


@query("cast_numeric", """
SELECT l_orderkey, l_linenumber,
       TRY_CAST(CASE WHEN l_returnflag = 'R' THEN 'bad' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE) AS quantity,
       TRY_CAST(CASE WHEN l_linestatus = 'O' THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS INTEGER) AS supplier
FROM lineitem""")
def cast_numeric(t: Tables) -> DataFrame:
    texts = t.lineitem.select(
        *LINE_KEY,
        F.when(F.col("l_returnflag") == "R", "bad")
        .otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(F.col("l_linestatus") == "O", "")
        .otherwise(F.col("l_suppkey").cast("string")).alias("supplier"),
    )
    return P.cast_numeric(texts, {"quantity": "double", "supplier": "int"})


@query("strip_chars", r"""
SELECT page_id, regexp_replace(url, '[\\/*?:"<>|]', '', 'g') AS url,
       replace(html, '"', '') AS html
FROM pages""")
def strip_chars(t: Tables) -> DataFrame:
    return P.strip_chars(t.pages, {"url": TITLE_CHARS, "html": '"'})


@query("floor_bucket", """
SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 5) AS BIGINT) AS rating_group
FROM lineitem""")
def floor_bucket(t: Tables) -> DataFrame:
    scored = t.lineitem.select(*LINE_KEY, (F.col("l_quantity") / 5).alias("score"))
    return P.floor_bucket(scored, "score", "rating_group").drop("score")


@query("select_alias", """
SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
FROM lineitem""")
def select_alias(t: Tables) -> DataFrame:
    return P.select_alias(t.lineitem, {
        "l_orderkey": "id", "l_linenumber": "line", "l_extendedprice": "price",
        "l_discount": "discount", "l_tax": "tax",
    })


@query("prefix_path", f"""
SELECT page_id, '{BASE}' || CASE WHEN url LIKE '%ref=%' THEN NULL ELSE url END AS url
FROM pages""")
def prefix_path(t: Tables) -> DataFrame:
    paths = t.pages.select("page_id", F.when(~F.col("url").contains("ref="), F.col("url")).alias("url"))
    return P.prefix_path(paths, "url", BASE)


@query("date_parts", """
WITH dated AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CAST(o_orderdate AS DATE) END AS order_date FROM orders)
SELECT o_orderkey, order_date, CAST(year(order_date) AS INTEGER) AS order_year,
       CAST(month(order_date) AS INTEGER) AS order_month, CAST(day(order_date) AS INTEGER) AS order_day
FROM dated""")
def date_parts(t: Tables) -> DataFrame:
    # Finished orders get a month 13; pending ones no date, or the date that stands for none.
    texts = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-'13'-dd"))
        .when((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1"), MISSING_DATE)
        .when(F.col("o_orderstatus") == "P", "")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
    )
    return P.date_parts(texts, "order_date", "order")


def _part_texts(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.nullif("p_name", F.lit("small ring")).alias("name"),
        F.nullif("p_brand", F.lit("Brand#2")).alias("brand"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("type"),
    )


_PART_TEXTS = """
WITH texts AS (
  SELECT p_partkey, nullif(p_name, 'small ring') AS name, nullif(p_brand, 'Brand#2') AS brand,
         nullif(p_type, 'ECONOMY') AS type
  FROM part)"""


@query("concat_fill", _PART_TEXTS + """
SELECT p_partkey, name || ' ' || coalesce(brand, '') || ' ' || coalesce(type, '') AS text FROM texts""")
def concat_fill(t: Tables) -> DataFrame:
    return P.concat_fill(_part_texts(t), "text", "name", "brand", "type").select("p_partkey", "text")


@query("concat_skip_nulls", _PART_TEXTS + """
SELECT p_partkey, concat_ws(' ', name, brand, type) AS text FROM texts""")
def concat_skip_nulls(t: Tables) -> DataFrame:
    return P.concat_skip_nulls(_part_texts(t), "text", "name", "brand", "type").select("p_partkey", "text")


@query("default_fill_cast", """
SELECT o_orderkey, coalesce(l_linenumber, 0) AS line, coalesce(l_quantity, 0.0) AS quantity,
       coalesce(l_returnflag = 'R', false) AS returned
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def default_fill_cast(t: Tables) -> DataFrame:
    texts = orders_with_lines(t).select(
        "o_orderkey",
        F.col("l_linenumber").cast("string").alias("line"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.when(F.col("l_returnflag") == "R", "true").otherwise("none").alias("returned"),
    )
    return P.default_fill_cast(
        texts, {"line": ("int", 0), "quantity": ("double", 0.0), "returned": ("boolean", False)}
    )


@query("sentinel_to_null", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
       CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderpriority END AS priority,
       CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS order_date
FROM orders""")
def sentinel_to_null(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    texts = t.orders.select(
        "o_orderkey",
        F.when(status == "P", "None").otherwise(status).alias("status"),
        F.when(priority == "5-LOW", " NA ").when(priority == "4-NOT SPECIFIED", "Not Available")
        .otherwise(priority).alias("priority"),
        F.when(status == "F", MISSING_DATE)
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
    )
    return P.sentinel_to_null(texts, sentinels=[*SENTINELS, MISSING_DATE])


@query("scrub_newlines", """
SELECT doc_id, translate(text, chr(10) || chr(13), '  ') AS text,
       translate(lang, chr(10) || chr(13), '  ') AS lang,
       translate(source, chr(10) || chr(13), '  ') AS source, n_chars
FROM documents""")
def scrub_newlines(t: Tables) -> DataFrame:
    return P.scrub_newlines(t.documents)


def part_names(t: Tables) -> DataFrame:
    """Each part with the words of its name, its type and its brand as an array of structs."""
    names = F.concat(F.split("p_name", " "), F.array("p_type", "p_brand"))
    marked = F.transform(names, lambda n: F.when(n == "ECONOMY", "N/A").when(n != "Brand#2", n))
    return t.part.select("p_partkey", F.transform(marked, lambda n: F.struct(n.alias("name"))).alias("names"))


_PART_NAMES = """
list_filter(list_concat(string_split(p_name, ' '), [p_type, p_brand]),
            lambda n: n NOT IN ('ECONOMY', 'Brand#2'))"""


@query("flatten_struct_array", f"""
SELECT p_partkey, nullif(array_to_string({_PART_NAMES}, ', '), '') AS names FROM part""")
def flatten_struct_array(t: Tables) -> DataFrame:
    return P.flatten_struct_array(part_names(t), {"names": "name"})


@query("json_names_to_string", """
SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN array_to_string(string_split(p_name, ' '), ', ') END AS keywords
FROM part""")
def json_names_to_string(t: Tables) -> DataFrame:
    words = F.transform(F.split("p_name", " "), lambda n: F.struct(n.alias("name")))
    doc = F.when(F.col("p_type") != "ECONOMY", F.to_json(F.struct(words.alias("keywords"))))
    return P.json_names_to_string(
        t.part.select("p_partkey", doc.alias("keywords")), "keywords", KEYWORD_DOC, "keywords"
    )


@query("json_scalar", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_scalar(t: Tables) -> DataFrame:
    scalars = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return P.cast_numeric(scalars, {"k": "bigint"})


@query("filter_min_count", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10""")
def filter_min_count(t: Tables) -> DataFrame:
    return L.filter_min(t.lineitem.select(*LINE_KEY, "l_quantity"), "l_quantity", 10)


@query("filter_min_bucket", """
SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 5) AS BIGINT) AS rating_group
FROM lineitem WHERE l_quantity >= 10 AND floor(l_quantity / 5) >= 7""")
def filter_min_bucket(t: Tables) -> DataFrame:
    voted = L.filter_min(t.lineitem, "l_quantity", 10)
    scored = voted.select(*LINE_KEY, (F.col("l_quantity") / 5).alias("score"))
    return L.filter_min(P.floor_bucket(scored, "score", "rating_group"), "rating_group", 7).drop("score")


@query("drop_nulls_subset", """
SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_totalprice IS NOT NULL AND l_linenumber IS NOT NULL AND l_quantity IS NOT NULL""")
def drop_nulls_subset(t: Tables) -> DataFrame:
    joined = orders_with_lines(t).select("o_orderkey", "o_totalprice", "l_linenumber", "l_quantity")
    return L.drop_nulls_subset(joined, ["o_totalprice", "l_linenumber", "l_quantity"])


@query("filter_nonblank", r"""
SELECT doc_id FROM documents
WHERE trim(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z\x09-\x0d ]', '', 'g'), '[\x09-\x0d ]+', ' ', 'g')) <> ''
""")
def filter_nonblank(t: Tables) -> DataFrame:
    return L.filter_nonblank(clean_alpha(t.documents, "text", "cleaned"), "cleaned").select("doc_id")
