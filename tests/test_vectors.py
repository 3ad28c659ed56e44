"""Vector operators against numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import principal as P
from shelfmark.operators import vectors as V

RNG = np.random.default_rng(3)
POINTS = np.vstack([RNG.normal(0, 0.2, (60, 5)), RNG.normal(4, 0.2, (40, 5))]).astype("float32")


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(POINTS)] + [(999, None)]
    return spark.createDataFrame(rows, "id int, v array<float>")


def test_assemble(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "a double, b double")
    assert [list(r.features) for r in V.assemble_vector(df, ["a", "b"], invalid="skip").collect()] == [[1.0, 2.0]]
    with pytest.raises(Exception, match="null while assembling"):
        V.assemble_vector(df, ["a", "b"]).collect()


def test_gather_columns_in_number_order(spark):
    df = spark.createDataFrame([("t", 2.0, 10.0, 0.0)], "title string, f_2 double, f_10 double, f_0 double")
    assert V.gather_columns(df, "title", "f_", "v").first().v == [0.0, 2.0, 10.0]


def test_kmeans_assigns_the_nearest_centre(points):
    model = V.kmeans_fit(points, "v", k=2)
    centres = np.array(model.clusterCenters())
    got = {r.id: r.cluster for r in V.kmeans_assign(points, "v", model=model).collect()}
    assert set(got) == set(range(100))
    for i, p in enumerate(POINTS):
        assert got[i] == int(np.argmin(((centres - p) ** 2).sum(axis=1)))
    assert len({got[i] for i in range(60)}) == len({got[i] for i in range(60, 100)}) == 1
    assert got[0] != got[99]


def test_kmeans_default_makes_k_clusters(points):
    assigned = V.kmeans_assign(points, "v").select("cluster").distinct().collect()
    assert {r.cluster for r in assigned} <= set(range(5)) and len(assigned) == 5


def by_hand(rows, k, seed, rounds):
    """The draws and rounds of ``kmeans_centres``, row by row."""
    centres = []
    for draw in range(k):
        raced = []
        for i, v in rows:
            time = -math.log((int(hashlib.md5(f"{seed}:{draw}:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32)
            away = min((sum((x - y) ** 2 for x, y in zip(v, c)) for c in centres), default=1.0)
            if away > 0:
                raced.append((time / away, str(i), v))
        centres.append(min(raced)[2])
    for _ in range(rounds):
        near = [min(range(k), key=lambda c: (sum((x - y) ** 2 for x, y in zip(v, centres[c])), c)) for _, v in rows]
        for c in range(k):
            own = [v for (_, v), n in zip(rows, near) if n == c]
            if own:
                centres[c] = [sum(math.floor(x * V.FINE + 0.5) for x in column) / V.FINE / len(own) for column in zip(*own)]
    return centres


def test_kmeans_does_not_depend_on_how_rows_are_dealt(spark):
    points = RNG.normal(0, 1, (300, 4))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(400 + i, [9.0] * 4) for i in range(50)]
    df = spark.createDataFrame([*rows, (999, None)], "id int, v array<double>")
    want = by_hand(rows, 4, 7, 6)
    for parts in (1, 7, 64):
        assert V.kmeans_centres(df.repartition(parts, F.rand(parts)), "v", "id", 4, 7, 6) == want
    assert V.kmeans_centres(df.filter("id >= 400"), "v", "id", 4, 7, 6) == [[9.0] * 4]
    assert V.kmeans_assign(df.limit(0), "v").count() == 0


def by_svd(points, k):
    centred = points - points.mean(axis=0)
    loadings = np.linalg.svd(centred, full_matrices=False)[2][:k].T
    return centred @ (loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)]))


def scores(df, k):
    return {r[0]: list(r[1:]) for r in P.pca_project(df, "id", "v", k).collect()}


def test_pca_equals_numpy(points):
    got, want = scores(points, 2), by_svd(POINTS.astype(float), 2)
    assert sorted(got) == list(range(100))
    assert np.array([got[i] for i in range(100)]) == pytest.approx(want, abs=1e-6)


def test_pca_of_a_flat_spectrum_in_many_tasks(spark):
    # More dimensions than directions held, eigenvalues close together, a mean far from nought.
    points = np.random.default_rng(8).normal(50, 1, (1200, 300)) * np.linspace(1, 1.5, 300)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, v array<double>").repartition(9)
    got = scores(df, 3)
    assert np.array([got[i] for i in range(len(points))]) == pytest.approx(by_svd(points, 3), abs=1e-6)


def test_pca_of_long_vectors(spark):
    width = 20_000
    df = spark.range(0, 60, 1, 4).select(
        F.col("id"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.sin(F.col("id") * j * 0.7 + j) + (F.col("id") % 7) * F.cos(j * 0.1)).alias("v"))
    points = np.array([r.v for r in df.orderBy("id").collect()])
    got = scores(df, 2)
    assert np.array([got[i] for i in range(60)]) == pytest.approx(by_svd(points, 2), abs=1e-6)


def test_pca_edges(spark, points):
    assert scores(points.limit(0), 2) == {} and scores(points.filter("id = 999"), 2) == {}
    same = spark.createDataFrame([("a", [1.0, 2.0, 3.0])] * 5 + [(None, [1.0, 2.0, 3.0])], "id string, v array<double>")
    assert scores(same, 2) == {"a": [0.0, 0.0], None: [0.0, 0.0]}
    with pytest.raises(ValueError, match="1 to 3 components"):
        P.pca_project(same, "id", "v", 4)
    uneven = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, v array<double>")
    with pytest.raises(Exception, match="numbers|imension"):
        P.pca_project(uneven, "id", "v").collect()
