"""Vector assembly and K-means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.schema import CLUSTER_SEED, CLUSTERS

KMEANS_ROUNDS = 10
FINE = 1 << 20  # coordinates are summed in whole numbers of this part of one


def assemble_vector(
    df: DataFrame, columns: Sequence[str], out: str = "features", invalid: str = "error"
) -> DataFrame:
    """Numeric columns as one vector; a missing value is an error, or drops the row (``skip``)."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid=invalid).transform(df)


def gather_columns(df: DataFrame, key: str, prefix: str, out: str) -> DataFrame:
    """A wide table ``prefix0, prefix1, ..`` as one array column per row."""
    wide = sorted(
        (c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()),
        key=lambda c: int(c[len(prefix):]),
    )
    return df.select(key, F.array(*(F.col(c).cast("float") for c in wide)).alias(out))


def kmeans_fit(
    df: DataFrame, vector: str, k: int = CLUSTERS, seed: int = CLUSTER_SEED, **params
) -> KMeansModel:
    """K-means model of an array column (runs jobs)."""
    features = df.filter(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector)).alias("features"))
    return KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=seed, **params).fit(features)


def kmeans_assign(
    df: DataFrame, vector: str, k: int = CLUSTERS, seed: int = CLUSTER_SEED, model: KMeansModel | None = None, key: str = "id", rounds: int = KMEANS_ROUNDS
) -> DataFrame:
    """Add ``cluster``, the nearest centre, by a fitted model, or by the centres of ``kmeans_centres``; rows without a vector go."""
    filled = df.filter(F.col(vector).isNotNull())
    if model is None:
        centres = kmeans_centres(df, vector, key, k, seed, rounds)
        return filled.withColumn("cluster", _nearest(F.col(vector).cast("array<double>"), centres)[0] if centres else F.lit(None).cast("int"))
    # A column name of its own, so that one named like the model's input stays.
    features = filled.withColumn("_features", array_to_vector(F.col(vector)))
    return model.copy().setFeaturesCol("_features").transform(features).drop("_features")


def kmeans_centres(df: DataFrame, vector: str, key: str, k: int, seed: int, rounds: int) -> list[list[float]]:
    """Centres of K-means that depend on the rows only, not on how they are dealt (runs up to ``k`` and ``rounds`` jobs).

    Each first centre is drawn with a probability in proportion to its squared distance from those before (k-means++), as a race: every row
    has a random time, from a hash of seed, draw and key, divided by its squared distance, and the earliest row wins, so one
    aggregate finds it. In each round a centre moves to the mean of the rows nearest to it, whose coordinates are summed as whole
    numbers of ``1 / FINE``: such sums are exact in any order. It ends early when no centre moves. Equal distances go to the first centre; a centre
    without rows stays. With fewer than ``k`` different vectors there are fewer centres. The driver gets ``k`` times the width numbers a round.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    centres: list[list[float]] = []
    for draw in range(k):
        digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{draw}:"), F.coalesce("key", F.lit("")))), 1, 8)
        time = -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**32))
        away = _nearest(F.col("v"), centres)[1] if centres else F.lit(1.0)
        raced = rows.select("v", "key", time.alias("time"), away.alias("away")).filter("away > 0")
        first = raced.agg(F.min_by("v", F.struct(F.col("time") / F.col("away"), "key", "v"))).first()[0]
        if first is None:
            break
        centres.append(list(first))
    whole = F.floor(F.col("x") * F.lit(float(FINE)) + 0.5).cast("bigint")
    for _ in range(rounds if centres else 0):
        # The cluster first, else it would be found anew for each coordinate.
        near = rows.select(_nearest(F.col("v"), centres)[0].alias("cluster"), "v").select("cluster", F.posexplode_outer("v").alias("dim", "x"))
        sums = near.filter("dim IS NOT NULL").groupBy("cluster", "dim").agg(F.sum(whole).alias("total"), F.count("x").alias("rows")).collect()
        moved = [list(c) for c in centres]
        for r in sums:
            if r["rows"]:
                moved[r["cluster"]][r["dim"]] = r["total"] / FINE / r["rows"]
        if moved == centres:
            break
        centres = moved
    return centres


def _nearest(vector: Column, centres: list[list[float]]) -> tuple[Column, Column]:
    """Number of the nearest centre, from 0, and the squared distance to it; squares are added in the order of the dimensions."""
    literal = lambda c: F.expr(f"array({', '.join(f'double({x!r})' for x in c)})")
    square = lambda c: F.aggregate(F.zip_with(vector, literal(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    found = F.array_min(F.array(*(F.named_struct(F.lit("away"), square(c), F.lit("cluster"), F.lit(i)) for i, c in enumerate(centres))))
    return found["cluster"], found["away"]
