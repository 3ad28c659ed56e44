"""Sorting, limits and top-k on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.bindings.registry import Tables, query, rounded
from shelfmark.bindings.relations import labelled_metadata
from shelfmark.bindings.stats import TAG_COUNTS
from shelfmark.operators import aggregate as A
from shelfmark.operators import rank as R

DIM_MEANS = """
SELECT dim, avg(CAST(v AS DOUBLE)) AS mean
FROM (SELECT CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, unnest(embedding) AS v FROM embeddings)
GROUP BY dim"""
LABEL_DIM_MEANS = """
SELECT label, dim, avg(CAST(v AS DOUBLE)) AS mean
FROM (SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, unnest(embedding) AS v FROM embeddings)
GROUP BY label, dim"""


@query("top_tags_per_cluster", f"""
WITH counts AS ({TAG_COUNTS})
SELECT label, tag, count FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY count DESC, tag) AS pos FROM counts)
WHERE pos <= 5""")
def top_tags_per_cluster(t: Tables) -> DataFrame:
    counts = A.tag_counts_per_cluster(labelled_metadata(t), "label", "tags")
    return R.top_tags_per_cluster(counts, "label", "tag")


@query("top_dims", f"SELECT dim, round(mean, 6) AS mean FROM ({DIM_MEANS}) ORDER BY mean DESC, dim LIMIT 10")
def top_dims(t: Tables) -> DataFrame:
    return R.top_dims(A.mean_vector(t.embeddings, "embedding")).withColumn("mean", rounded("mean"))


@query("top_items_on_top_dim", f"""
WITH best AS (SELECT dim FROM ({DIM_MEANS}) ORDER BY mean DESC, dim LIMIT 1)
SELECT vec_id, dim, embedding[dim + 1] AS value FROM embeddings, best
ORDER BY value DESC, vec_id LIMIT 10""")
def top_items_on_top_dim(t: Tables) -> DataFrame:
    means = A.mean_vector(t.embeddings, "embedding")
    return R.top_items_on_top_dim(t.embeddings, means, "vec_id", "embedding")


_TOP_LABEL_DIMS = f"""
SELECT label, CAST(pos AS INTEGER) AS dim_rank, dim, mean FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean DESC, dim) AS pos FROM ({LABEL_DIM_MEANS}))
WHERE pos <= """


@query("top_dims_per_cluster", f"SELECT label, dim_rank, dim, round(mean, 6) AS mean FROM ({_TOP_LABEL_DIMS} 5)")
def top_dims_per_cluster(t: Tables) -> DataFrame:
    means = A.mean_vector(t.embeddings, "embedding", ["label"])
    return R.top_dims_per_cluster(means, "label").withColumn("mean", rounded("mean"))


@query("top_items_per_dim_per_cluster", f"""
WITH best AS ({_TOP_LABEL_DIMS} 3),
ranked AS (
  SELECT label, dim_rank, dim, mean, vec_id, embedding[dim + 1] AS value,
         row_number() OVER (PARTITION BY label, dim_rank ORDER BY embedding[dim + 1] DESC, vec_id) AS pos
  FROM embeddings JOIN best USING (label))
SELECT label, dim_rank, dim, round(mean, 6) AS mean, CAST(pos AS INTEGER) AS item_rank, vec_id, value
FROM ranked WHERE pos <= 3""")
def top_items_per_dim_per_cluster(t: Tables) -> DataFrame:
    means = A.mean_vector(t.embeddings, "embedding", ["label"])
    top = R.top_items_per_dim_per_cluster(t.embeddings, means, "vec_id", "embedding", "label")
    return top.select("label", "dim_rank", "dim", rounded("mean").alias("mean"), "item_rank", "vec_id", "value")


@query("sort_by_score", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey""")
def sort_by_score(t: Tables) -> DataFrame:
    return R.sort_by_score(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("limit_sample", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 1000")
def limit_sample(t: Tables) -> DataFrame:
    return R.limit_sample(t.embeddings.select("vec_id", "label"), 1000, "vec_id", F.asc("vec_id"))


@query("preview_rows", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 20")
def preview_rows(t: Tables) -> DataFrame:
    return R.preview_rows(t.embeddings, "vec_id", ["vec_id", "label"])
