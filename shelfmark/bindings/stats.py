"""Counts, profiles and correlations on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.bindings.columns import orders_with_lines
from shelfmark.bindings.registry import Tables, query, rounded
from shelfmark.bindings.relations import labelled_metadata
from shelfmark.operators import aggregate as A
from shelfmark.operators.filters import filter_min
from shelfmark.operators.project import floor_bucket

_MATRIX = ["rating_group", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_BANDED = ["price", "discounted", "taxed", "quantity", "returned", "again"]
_PROFILED = ["o_orderkey", "o_totalprice", "o_orderpriority", "l_linenumber", "l_quantity", "l_returnflag"]


@query("rating_distribution", """
SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS rating_group, count(*) AS count
FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 ORDER BY 1 DESC""")
def rating_distribution(t: Tables) -> DataFrame:
    scored = t.lineitem.select("l_quantity", (F.col("l_quantity") / 5).alias("score"))
    return A.rating_distribution(scored, "l_quantity", "score", 10)


@query("null_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(*) - count({c}) AS nulls
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""" for c in _PROFILED))
def null_profile(t: Tables) -> DataFrame:
    return A.null_profile(orders_with_lines(t), _PROFILED)


@query("nonconstant_columns", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(stddev_samp({c}), 6) AS stddev FROM lineitem"""
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]))
def nonconstant_columns(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumns({"same": F.lit(0.1), "none": F.lit(None).cast("double")})
    names = ["l_quantity", "same", "l_extendedprice", "none", "l_discount", "l_tax", "l_linenumber"]
    return A.nonconstant_columns(lines, names).withColumn("stddev", rounded("stddev"))


def _rated_lines(t: Tables) -> DataFrame:
    voted = filter_min(t.lineitem, "l_quantity", 10).withColumn("score", F.col("l_quantity") / 5)
    rated = filter_min(floor_bucket(voted, "score", "rating_group"), "rating_group", 7)
    return rated.withColumn("same", F.lit(0.1))


@query("correlation_matrix", """
WITH base AS (
  SELECT *, floor(l_quantity / 5) AS rating_group FROM lineitem
  WHERE l_quantity >= 10 AND floor(l_quantity / 5) >= 7)
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM base" for a in _MATRIX for b in _MATRIX))
def correlation_matrix(t: Tables) -> DataFrame:
    return A.correlation_matrix(_rated_lines(t), [*_MATRIX, "same"]).withColumn("r", rounded("r"))


@query("correlation_bands", """
WITH base AS (
  SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS discounted,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS taxed, l_quantity AS quantity,
         -l_quantity AS returned, l_quantity * 2 AS again
  FROM lineitem),
pairs AS (
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM base"
    for i, a in enumerate(_BANDED) for b in _BANDED[i + 1:]) + """),
banded AS (
  SELECT a, b, round(r, 6) AS r,
         CASE WHEN r >= 0.7 THEN 'Strong Positive' WHEN r >= 0.5 THEN 'Moderate Positive'
              WHEN r >= 0.3 THEN 'Weak Positive' WHEN r < -0.7 THEN 'Strong Negative'
              WHEN r < -0.5 THEN 'Moderate Negative' WHEN r < -0.3 THEN 'Weak Negative' END AS band
  FROM pairs)
SELECT a, b, r, band FROM banded WHERE band IS NOT NULL""")
def correlation_bands(t: Tables) -> DataFrame:
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    discounted = price * (1 - F.col("l_discount"))
    base = t.lineitem.select(
        price.alias("price"), discounted.alias("discounted"),
        (discounted * (1 + F.col("l_tax"))).alias("taxed"),
        quantity.alias("quantity"), (-quantity).alias("returned"), (quantity * 2).alias("again"),
    )
    bands = A.correlation_bands(A.correlation_matrix(base, _BANDED), _BANDED)
    return bands.withColumn("r", rounded("r"))


@query("cluster_sizes", "SELECT label, count(*) AS count FROM embeddings GROUP BY label")
def cluster_sizes(t: Tables) -> DataFrame:
    return A.cluster_sizes(t.embeddings, "label")


@query("avg_bucket_per_cluster", """
SELECT label, round(avg(floor(n_chars / 1000)), 6) AS avg_bucket
FROM embeddings LEFT JOIN documents ON vec_id = doc_id GROUP BY label""")
def avg_bucket_per_cluster(t: Tables) -> DataFrame:
    averages = A.avg_bucket_per_cluster(labelled_metadata(t), "label", "bucket")
    return averages.withColumn("avg_bucket", rounded("avg_bucket"))


TAG_COUNTS = """
SELECT label, trim(tag) AS tag, count(*) AS count
FROM (SELECT label, unnest(string_split(lang || ', ' || source, ',')) AS tag
      FROM embeddings LEFT JOIN documents ON vec_id = doc_id)
WHERE trim(tag) <> '' GROUP BY 1, 2"""


@query("tag_counts_per_cluster", TAG_COUNTS)
def tag_counts_per_cluster(t: Tables) -> DataFrame:
    return A.tag_counts_per_cluster(labelled_metadata(t), "label", "tags")
