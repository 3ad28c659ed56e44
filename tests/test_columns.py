"""Projections and filters on small literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import filters as L
from shelfmark.operators import project as P
from shelfmark.schema import KEYWORD_DOC, SENTINELS


def values(df, column):
    return [r[column] for r in df.orderBy("k").collect()]


def frame(spark, rows, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"k int, v {dtype}")


def test_cast_numeric_gives_null_for_bad_values(spark):
    df = P.cast_numeric(frame(spark, ["1.5", "x", "", None, "7"]), {"v": "double"})
    assert values(df, "v") == [1.5, None, None, None, 7.0]


def test_strip_chars_removes_every_listed_character(spark):
    df = P.strip_chars(frame(spark, ['a\\/*?:"<>|b', "plain", None]), {"v": '\\/*?:"<>|'})
    assert values(df, "v") == ["ab", "plain", None]


def test_floor_bucket(spark):
    df = P.floor_bucket(frame(spark, [7.0, 7.99, -0.5, None], "double"), "v", "b")
    assert values(df, "b") == [7, 7, -1, None]


def test_date_parts_takes_bad_and_missing_dates_as_null(spark):
    texts = ["1999-12-31", "1999-13-03", "", None, "1500-01-01", "2024-02-29", "2023-02-29"]
    df = P.date_parts(frame(spark, texts), "v", "d")
    assert values(df, "v") == [dt.date(1999, 12, 31), None, None, None, None, dt.date(2024, 2, 29), None]
    assert values(df, "d_year") == [1999, None, None, None, None, 2024, None]
    assert values(df, "d_month") == [12, None, None, None, None, 2, None]
    assert values(df, "d_day") == [31, None, None, None, None, 29, None]


def test_concat_forms_differ_on_nulls(spark):
    rows = [(0, "a", None, "c"), (1, None, "b", None), (2, "a", "", "c")]
    df = spark.createDataFrame(rows, "k int, x string, y string, z string")
    assert values(P.concat_fill(df, "t", "x", "y", "z"), "t") == ["a  c", None, "a  c"]
    assert values(P.concat_skip_nulls(df, "t", "x", "y", "z"), "t") == ["a c", "b", "a  c"]


def test_default_fill_cast(spark):
    df = P.default_fill_cast(frame(spark, ["3", None, "bad"]), {"v": ("bigint", 0)})
    assert values(df, "v") == [3, 0, 0] and dict(df.dtypes)["v"] == "bigint"


def test_sentinels_become_null_and_other_texts_stay(spark):
    df = P.sentinel_to_null(frame(spark, [*SENTINELS, " NA ", "Nadia", None]))
    assert values(df, "v") == [None] * len(SENTINELS) + [None, "Nadia", None]


def test_scrub_newlines_touches_all_text_columns(spark):
    df = P.scrub_newlines(frame(spark, ["a\nb\rc", "\r\n", None]))
    assert values(df, "v") == ["a b c", "  ", None]


def test_flatten_struct_array(spark):
    rows = [[("Drama",), ("Action",)], [("NA",), (None,)], [], None, [("",), ("War",)]]
    df = frame(spark, rows, "array<struct<name:string>>")
    flat = P.flatten_struct_array(df, {"v": "name"})
    assert values(flat, "v") == ["Drama, Action", None, None, None, "War"]


def test_json_names(spark):
    rows = ['{"keywords": [{"name": "a"}, {"name": "b"}]}', '{"keywords": []}', "{}", "not json", None]
    df = P.json_names_to_string(frame(spark, rows), "v", KEYWORD_DOC, "keywords")
    assert values(df, "v") == ["a, b", None, None, None, None]


def test_prefix_path_keeps_null(spark):
    assert values(P.prefix_path(frame(spark, ["/p", None]), "v", "base"), "v") == ["base/p", None]


def test_select_alias_renames_or_picks(spark):
    df = frame(spark, ["a"])
    assert P.select_alias(df, {"v": "w"}).columns == ["w"]
    assert P.select_alias(df, ["v"]).columns == ["v"]


def test_drop_nulls_counts_nan_as_missing(spark):
    df = frame(spark, [1.0, float("nan"), None], "double")
    assert values(L.drop_nulls_subset(df, ["k", "v"]), "v") == [1.0]


def test_filter_nonblank(spark):
    assert values(L.filter_nonblank(frame(spark, [None, "", " ", " a", "7"]), "v"), "v") == [" a", "7"]


@pytest.mark.parametrize("low, kept", [(10, [10, 11]), (11, [11]), (12, [])])
def test_filter_min(spark, low, kept):
    assert values(L.filter_min(frame(spark, [9, 10, 11, None], "int"), "v", low), "v") == kept


def test_exploded_skips_nulls_and_empty(spark):
    df = frame(spark, [["a", None], [], None], "array<string>")
    assert [tuple(r) for r in P.exploded(df, ["k"], F.col("v"), "w").collect()] == [(0, "a")]
