"""Joins, de-duplication, set operations."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import relate as J
from shelfmark.operators.dedup import dedup_by_id, dedup_keep_first, quarantine_missing
from shelfmark.plans.harvest import merge_daily


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_membership_joins_ignore_repeated_keys_and_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    done = spark.createDataFrame([(1,), (1,), (None,), (3,)], "k int")
    assert rows(J.semi_join_available(df, done, "k")) == [(1,), (1,)]
    assert rows(J.anti_join_pending(df, done, "k")) == [(2,), (None,)]


def test_left_join_keeps_rows_without_partner(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    labels = spark.createDataFrame([(1, 7)], "k int, label int")
    assert rows(J.left_join_unique(df, labels, "k")) == sorted([(1, "a", 7), (2, "b", None), (None, "c", None)], key=repr)


def test_assert_unique(spark):
    J.assert_unique(spark.createDataFrame([(1,), (2,)], "k int"), ["k"])
    with pytest.raises(ValueError, match="repeated"):
        J.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_embedding_or_zero(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    vectors = spark.createDataFrame([(1, [0.5, 1.0])], "k int, v array<float>")
    assert rows(J.embedding_or_zero(df, vectors, "k", "v", 2)) == [(1, [0.5, 1.0]), (2, [0.0, 0.0])]


def test_id_frontier_is_open_below_and_closed_above(spark):
    held = spark.createDataFrame([(3,), (5,)], "id bigint")
    done = spark.createDataFrame([(7,)], "id bigint")
    assert rows(J.id_frontier(held, "id", 8)) == [(6,), (7,), (8,)]
    assert rows(J.id_frontier(held, "id", 8, done)) == [(6,), (8,)]
    assert rows(J.id_frontier(held, "id", 5)) == []
    assert rows(J.id_frontier(held.filter("id > 9"), "id", 1)) == [(0,), (1,)]


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, k int")
    assert rows(J.union_by_name(a, b)) == [(1, "x", None), (2, None, "y")]


def test_dedup_takes_the_first_by_order_then_tie(spark):
    df = spark.createDataFrame(
        [("t", "d", 5, 2), ("t", "d", 9, 4), ("t", "d", 9, 3), ("t", None, 1, 5), ("t", None, 0, 6), ("t", "e", 0, 7)],
        "title string, day string, votes int, id int",
    )
    got = dedup_keep_first(df, ["title", "day"], [F.desc("votes"), F.asc("id")])
    assert sorted(r.id for r in got.collect()) == [3, 5, 7]


def test_dedup_by_id(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "id int, seq int")
    assert rows(dedup_by_id(df, "id", [F.asc("seq")])) == [(1, 1), (2, 5)]


def test_quarantine(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, "{bad")], "id int, _corrupt string")
    good, bad = quarantine_missing(df, "id", "_corrupt")
    assert rows(good) == [(1, None)] and len(rows(bad)) == 2


def test_merge_prefers_new_rows_and_sorts(spark):
    old = spark.createDataFrame([(1, 10, "old"), (2, 20, "old")], "id int, votes int, src string")
    new = spark.createDataFrame([(2, 5, "new"), (3, 7, "new"), (3, 9, "newer")], "id int, votes int, src string")
    got = [tuple(r) for r in merge_daily(old, new, "id", "votes").collect()]
    assert got == [(1, 10, "old"), (3, 9, "newer"), (2, 5, "new")]


@pytest.fixture
def small_partitions(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("join", ["left", "semi", "anti"])
def test_a_hot_key_is_split_over_tasks(spark, small_partitions, join):
    n = 120_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    df = spark.range(0, n, 1, 12).select(hot.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    other = spark.range(0, n, 2).select(F.col("id").alias("k"), F.lit(1).alias("one")).union(
        spark.range(0, 1).select(F.lit(7).alias("k"), F.lit(1).alias("one"))
    )
    joined = {
        "left": lambda: J.left_join_unique(df, other, "k"),
        "semi": lambda: J.semi_join_available(df, other, "k"),
        "anti": lambda: J.anti_join_pending(df, other, "k"),
    }[join]()
    count = joined.selectExpr("count(v) as n")
    got = count.collect()[0].n
    plan = count._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan
    kept = n // 3 + sum(1 for i in range(n) if i % 3 and i % 2 == 0) + (1 if 7 % 3 else 0)
    assert got == {"left": n, "semi": kept, "anti": n - kept}[join]


def test_stopword_filter_keeps_rows_without_a_word(spark):
    df = spark.createDataFrame([("the",), ("sea",), (None,)], "word string")
    assert rows(J.anti_join_stopwords(df, ["the", "a"])) == [("sea",), (None,)]


def test_merge_dedupes_the_old_catalogue(spark):
    old = spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "id int, votes int")
    new = spark.createDataFrame([(3, 4)], "id int, votes int")
    assert [tuple(r) for r in merge_daily(old, new, "id", "votes").collect()] == [(1, 9), (3, 4), (2, 3)]


def test_a_join_that_multiplies_rows_fails_after_its_job(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    once = spark.createDataFrame([(1, 7), (5, 8)], "k int, w int")
    joined, check = J.left_join_checked(df, once, "k")
    joined.write.parquet(str(tmp_path / "once"))
    assert check.verify() == 3
    joined, check = J.left_join_checked(df, once.union(once), "k")
    joined.write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="4 rows of 3"):
        check.verify()


def test_held_ids_as_intervals_and_what_is_missing(spark):
    """Blocks full of ids, gaps at and across the edges of blocks, repeated and missing ids."""
    held = [*range(0, 40), *range(41, 64), 70, 70, *range(95, 161), 200, -3, -2, None]
    df = spark.createDataFrame([(i,) for i in held], "id long").repartition(5)
    for block in (8, 32, 1 << 16):
        got = sorted(map(tuple, J.held_intervals(df, "id", block).collect()))
        assert got == [(-3, -2), (0, 39), (41, 63), (70, 70), (95, 160), (200, 200)]
    done = spark.createDataFrame([(40,), (161,), (None,)], "id long")
    missing = lambda *a: sorted(r.id for r in J.missing_ids(df, "id", *a, block=16).collect())
    assert missing(10, 210) == [i for i in range(10, 211) if i not in held]
    assert missing(10, 210, done) == [i for i in range(10, 211) if i not in held and i not in (40, 161)]
    assert missing(45, 50) == [] and missing(300, 299) == [] and missing(300, 301) == [300, 301]
    assert J.missing_ids(df.limit(0), "id", 0, 200_000).count() == 200_001
