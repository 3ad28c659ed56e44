"""Counts, profiles, correlations, means, rankings on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import aggregate as A
from shelfmark.operators import rank as R
from shelfmark.operators.comoments import comoments


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rating_distribution(spark):
    df = spark.createDataFrame([(10, 7.9), (9, 7.0), (50, 7.0), (12, 5.5), (11, None)], "votes int, score double")
    assert rows(A.rating_distribution(df, "votes", "score", 10)) == [(7, 2), (5, 1), (None, 1)]


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert sorted(rows(A.null_profile(df))) == [("a", 2, 1), ("b", 1, 2)]


NUMERIC = [
    (1.0, 2.0, -1.0, 5.0, None, 0.1),
    (2.0, 4.0, -2.0, 1.0, None, 0.1),
    (3.0, 6.0, -3.0, 4.0, None, 0.1),
    (4.0, 8.0, -4.0, 9.0, None, 0.1),
]
NAMES = ["x", "double", "minus", "loose", "empty", "same"]


def numeric(spark):
    return spark.createDataFrame(NUMERIC, ", ".join(f"`{n}` double" for n in NAMES))


def test_nonconstant_columns(spark):
    got = dict(rows(A.nonconstant_columns(numeric(spark), NAMES)))
    assert set(got) == {"x", "double", "minus", "loose"}
    assert got["x"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1))


def test_correlation_matrix_equals_numpy(spark):
    got = {(r.a, r.b): r.r for r in A.correlation_matrix(numeric(spark), NAMES).collect()}
    want = np.corrcoef(np.array([r[:4] for r in NUMERIC]).T)
    assert len(got) == 16
    for i, a in enumerate(NAMES[:4]):
        for j, b in enumerate(NAMES[:4]):
            assert got[a, b] == pytest.approx(want[i, j])
    assert got["x", "double"] == 1.0 and got["x", "minus"] == -1.0


def test_correlation_uses_rows_with_both_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 5.0), (4.0, 4.0), (None, 9.0)], "a double, b double")
    got = {(r.a, r.b): r.r for r in A.correlation_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 3, 4], [1, 5, 4])[0, 1])


def test_correlation_of_large_means_gaps_and_many_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 7)) + 1e9
    x[:, 1] = 1e9 + 0.6 * (x[:, 0] - 1e9) + rng.normal(0, 0.5, 600)
    # Where column 2 is missing, column 3 lies a billion away from its other values.
    x[300:, 3] -= 1e9
    x[:, 5] = 0.1
    cells = [[None if (c == 2 and i >= 300) or (c == 4 and i % 3 == 0) else float(v) for c, v in enumerate(r)] for i, r in enumerate(x)]
    cells[7][6], cells[8][6] = float("nan"), float("inf")
    names = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame(cells, ", ".join(f"{n} double" for n in names))
    here = np.array([[v is not None and np.isfinite(v) for v in r] for r in cells])
    want = {}
    for a in range(7):
        for b in range(7):
            both = here[:, a] & here[:, b]
            if a != 5 and b != 5:
                want[names[a], names[b]] = np.corrcoef(x[both, a] - x[both, a][0], x[both, b] - x[both, b][0])[0, 1]
    for parts, block in ((1, 128), (9, 128), (9, 3)):
        pairs = {(r.a, r.b): r for r in comoments(df.repartition(parts), names, block).collect()}
        assert pairs[2, 3].n == 300 and pairs[2, 4].n == 200 and not pairs[0, 5].varies
        assert pairs[2, 3].m_bb == pytest.approx(((x[:300, 3] - x[:300, 3].mean()) ** 2).sum(), rel=1e-6)
        assert all(a <= b for a, b in pairs) and len(pairs) == 28
    got = {(r.a, r.b): r.r for r in A.correlation_matrix(df.repartition(9), names).collect()}
    assert got.keys() == want.keys()
    assert got == pytest.approx(want, abs=1e-6)


def test_correlation_of_nothing(spark):
    df = numeric(spark)
    assert A.correlation_matrix(df.limit(0), NAMES).count() == A.correlation_matrix(df, []).count() == 0
    assert A.correlation_matrix(df, ["empty", "same"]).count() == 0


@pytest.mark.parametrize("r, band", [
    (1.0, "Strong Positive"), (0.7, "Strong Positive"), (0.69, "Moderate Positive"), (0.5, "Moderate Positive"),
    (0.3, "Weak Positive"), (0.29, None), (0.0, None), (-0.3, None), (-0.31, "Weak Negative"),
    (-0.5, "Weak Negative"), (-0.6, "Moderate Negative"), (-0.7, "Moderate Negative"), (-1.0, "Strong Negative"),
])
def test_bands(spark, r, band):
    matrix = spark.createDataFrame([("p", "q", r), ("q", "p", r), ("p", "p", 1.0)], "a string, b string, r double")
    got = rows(A.correlation_bands(matrix, ["p", "q"]))
    assert got == ([] if band is None else [("p", "q", r, band)])


def test_tags_are_trimmed_and_blank_ones_dropped(spark):
    df = spark.createDataFrame([(1, "a, b"), (1, "a,, "), (2, None)], "c int, tags string")
    assert sorted(rows(A.tag_counts_per_cluster(df, "c", "tags"))) == [(1, "a", 2), (1, "b", 1)]


def test_word_counts_and_cluster_sizes(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b"]), (0, []), (1, None)], "c int, w array<string>")
    assert rows(A.word_counts(df, "w")) == [("b", 2), ("a", 1)]
    assert rows(A.cluster_sizes(df, "c")) == [(0, 2), (1, 1)]


def test_average_bucket_order(spark):
    df = spark.createDataFrame([(0, 7), (0, 8), (1, 9), (2, None)], "c int, b int")
    assert rows(A.avg_bucket_per_cluster(df, "c", "b")) == [(1, 9.0), (0, 7.5), (2, None)]


VECTORS = [(i, i % 3, [float((i * 7 + d * 3) % 11) for d in range(4)]) for i in range(40)]


def vectors(spark):
    df = spark.createDataFrame(VECTORS, "id int, c int, v array<float>")
    return df.repartition(5).union(spark.createDataFrame([(99, 0, None)], df.schema))


def test_mean_vector_equals_numpy_over_many_partitions(spark):
    got = dict(rows(A.mean_vector(vectors(spark), "v")))
    assert [got[d] for d in range(4)] == pytest.approx(list(np.mean([v for _, _, v in VECTORS], axis=0)))
    assert rows(A.mean_vector(vectors(spark).limit(0), "v")) == rows(A.mean_vector(vectors(spark).limit(0), "v", ["c"])) == []
    per = {(r.c, r.dim): r["mean"] for r in A.mean_vector(vectors(spark), "v", ["c"]).collect()}
    for c in range(3):
        want = np.mean([v for _, k, v in VECTORS if k == c], axis=0)
        assert [per[c, d] for d in range(4)] == pytest.approx(list(want))


def test_top_items_equal_brute_force(spark):
    df = vectors(spark)
    got = R.top_items_per_dim_per_cluster(
        df, A.mean_vector(df, "v", ["c"]), "id", "v", "c", dims=2, items=3
    ).collect()
    want = set()
    for c in range(3):
        group = [(i, v) for i, k, v in VECTORS if k == c]
        mean = np.mean([v for _, v in group], axis=0)
        for rank, d in enumerate(sorted(range(4), key=lambda d: (-mean[d], d))[:2], 1):
            best = sorted(group, key=lambda g: (-g[1][d], g[0]))[:3]
            want |= {(c, rank, d, pos, i, v[d]) for pos, (i, v) in enumerate(best, 1)}
    assert {(r.c, r.dim_rank, r.dim, r.item_rank, r.id, r.value) for r in got} == want
    overall = np.mean([v for _, _, v in VECTORS], axis=0)
    d = int(np.argmax(overall))
    items = rows(R.top_items_on_top_dim(df, A.mean_vector(df, "v"), "id", "v", 4))
    assert items == [(i, d, v[d]) for i, _, v in sorted(VECTORS, key=lambda r: (-r[2][d], r[0]))[:4]]


def test_top_per_group_beyond_the_planner_limit(spark):
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        # A third of the rows are copies of one row.
        df = spark.range(0, 3000, 1, 6).select(
            (F.col("id") % 2).alias("g"),
            F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"),
        )
        got = R.top_per_group(df, ["g"], [F.asc("v")], 600).select("g", "v").collect()
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)
    for g in (0, 1):
        want = sorted(-1 if i % 3 == 0 else i for i in range(3000) if i % 2 == g)[:600]
        assert sorted(r.v for r in got if r.g == g) == want


def test_orders(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, None)], "id int, s int")
    assert [r.id for r in R.sort_by_score(df, "s", "id").collect()] == [2, 1, 3, 4]
    assert [r.id for r in R.preview_rows(df, "id", ["id"], 2).collect()] == [1, 2]
    counted = [(0, "a", 1), (0, "b", 2), (1, "c", 1), (1, "a", 1), (1, "b", 1)]
    tags = spark.createDataFrame(counted, "c int, tag string, count long")
    assert rows(R.top_tags_per_cluster(tags, "c", "tag", k=2)) == [(1, "a", 1), (1, "b", 1), (0, "b", 2), (0, "a", 1)]


def test_sample_is_repeatable_whatever_the_partitions(spark):
    df = spark.range(1000)
    first = {r.id for r in R.limit_sample(df.repartition(7), 50, "id").collect()}
    assert len(first) == 50
    assert first == {r.id for r in R.limit_sample(df.repartition(3), 50, "id").collect()}
    assert first != set(range(50))


def test_observed_profile_is_the_profile_of_what_was_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "", None), (2, "x", 0.5), (None, None, None)], "a int, b string, c double").repartition(3)
    for empty_is_null, want in ((False, [("a", 2, 1), ("b", 2, 1), ("c", 1, 2)]), (True, [("a", 2, 1), ("b", 1, 2), ("c", 1, 2)])):
        seen, profile = A.observed_profile(df, empty_is_null)
        seen.write.parquet(str(tmp_path / str(empty_is_null)))
        assert [tuple(r) for r in profile.rows(spark).collect()] == want
    assert sorted(map(tuple, A.null_profile(df).collect())) == [("a", 2, 1), ("b", 2, 1), ("c", 1, 2)]
