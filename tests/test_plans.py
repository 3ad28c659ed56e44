"""Shapes of physical plans that matter at scale."""

import contextlib
import io
from pathlib import Path

import pytest

from shelfmark.bindings import QUERIES

SF_DIR = "/root/testdata/sf0.001"
JOBS = {"ingest_increment", "kmeans_assign", "pca_project"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, SF_DIR).explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield {name: plan(spark, name) for name in QUERIES if name not in JOBS}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_cross_join_and_no_python(plans):
    for name, text in plans.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
            assert bad not in text, (name, bad)


def test_only_bounded_sides_are_broadcast(plans):
    hinted = {name for name, text in plans.items() if "BroadcastExchange" in text}
    assert hinted == {"term_frequency_vectors", "tfidf"}


@pytest.mark.parametrize("name", [
    "dedup_keep_first", "dedup_by_id", "clean_catalog", "merge_daily", "top_tags_per_cluster",
    "top_items_per_dim_per_cluster",
])
def test_groups_are_cut_before_the_shuffle(plans, name):
    # One limit per task before the exchange and one after it.
    assert plans[name].count("WindowGroupLimit") >= 4  # tree and details


@pytest.mark.parametrize("name, filters", [
    ("filter_min_count", "GreaterThanOrEqual(l_quantity,10.0)"),
    ("rating_distribution", "GreaterThanOrEqual(l_quantity,10.0)"),
    ("drop_nulls_subset", "IsNotNull(l_quantity)"),
])
def test_filters_reach_the_scan(plans, name, filters):
    pushed = [line for line in plans[name].splitlines() if line.startswith("PushedFilters")]
    assert any(filters in line for line in pushed)


def test_scans_read_only_needed_columns(plans):
    schemas = [line for line in plans["rating_distribution"].splitlines() if line.startswith("ReadSchema")]
    assert schemas == ["ReadSchema: struct<l_quantity:double>"]
    schemas = [line for line in plans["semi_join_available"].splitlines() if line.startswith("ReadSchema")]
    assert "ReadSchema: struct<doc_id:bigint>" in schemas


def test_rows_are_counted_without_a_shuffle_of_the_rows(plans):
    # The vocabulary is the only thing grouped; the documents join it where they are.
    assert plans["tfidf"].count("hashpartitioning") == 1


def test_a_stop_list_is_a_filter(plans):
    text = plans["anti_join_stopwords"]
    assert "Join" not in text and "BroadcastExchange" not in text


def test_weights_read_the_words_once(plans):
    # Both sides of the join read the written runs; no text is cleaned in the plan.
    for name in ("tfidf", "term_frequency_vectors"):
        assert "regexp_replace" not in plans[name]


def test_queries_set_what_they_need(spark):
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    QUERIES["preview_rows"](spark, SF_DIR)
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
