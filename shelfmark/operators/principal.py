"""Principal components by block Krylov rounds: each is one job, and no matrix of dimensions by dimensions is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.aggregate import MERGE_SLICES, mean_vector

EXTRA = 30  # directions of a block beyond the wanted ones
MOST_DIRECTIONS = 256  # directions held before the basis is cut to its best ones
CLOSE = 1e-11  # a component is found when it is an eigenvector up to this part of the largest eigenvalue
MOST_ROUNDS = 200
_DIMS = 4096  # dimensions of one row of partial sums
_CELLS = 1 << 21  # numbers of a slice of rows


def _centred_slices(mean: np.ndarray) -> Callable:
    """A function from an Arrow batch and the place of its vectors to slices of rows, as ``(start, centred matrix)``.

    It carries all it needs with it, so workers do not need this package.
    """
    cells = _CELLS

    def slices(batch, column: int, origin) -> Iterator:
        import numpy

        step = max(1, cells // len(origin))
        for start in range(0, batch.num_rows, step):
            part = batch.column(column).slice(start, step)
            values = part.flatten()
            if len(values) != len(part) * len(origin) or values.null_count or set(part.value_lengths().to_pylist()) != {len(origin)}:
                raise ValueError(f"each vector must have {len(origin)} numbers")
            yield start, values.to_numpy(zero_copy_only=False).astype(float).reshape(len(part), len(origin)) - numpy.asarray(origin)

    return slices


def _times_covariance(vectors: DataFrame, rows: int, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The covariance matrix times ``block``, without the matrix: each row adds its vector times its products with the block.

    A task gives one partial sum, cut by dimensions; they are merged in two rounds. The driver gets as many numbers as ``block`` has.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((mean, block))
    slices, dims = _centred_slices(mean), _DIMS

    def partial(batches):
        import numpy
        import pyarrow

        origin, directions = shared.value
        total = numpy.zeros(directions.shape)
        seen = False
        for batch in batches:
            for _, x in slices(batch, 0, origin):
                total += x.T @ (x @ directions)
                seen = True
        if seen:
            for n, start in enumerate(range(0, len(total), dims)):
                sums = total[start : start + dims].ravel()
                yield pyarrow.RecordBatch.from_arrays([pyarrow.array([n], "int32"), pyarrow.array([sums.tolist()])], names=["part", "sums"])

    sums = vectors.mapInArrow(partial, "part int, sums array<double>")
    slot = F.pmod(F.spark_partition_id(), F.lit(MERGE_SLICES)).alias("_slice")
    merged = sums.select("part", slot, array_to_vector("sums").alias("v")).groupBy("part", "_slice").agg(Summarizer.sum(F.col("v")).alias("v"))
    whole = merged.groupBy("part").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("sums")).collect()
    shared.unpersist()
    flat = np.concatenate([np.asarray(r["sums"]) for r in sorted(whole, key=lambda r: r["part"])])
    return flat.reshape(block.shape) / rows


def principal_components(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and first ``k`` components (one a column) of an array column; None without a vector (runs a job a round).

    A block of ``k + EXTRA`` directions, drawn with a fixed seed, is multiplied by the covariance again and again; the
    components are sought among all directions met so far (Rayleigh and Ritz), of which the best are kept when there are more than
    ``MOST_DIRECTIONS``. It ends when each of the ``k`` is an eigenvector up to ``CLOSE``, or the directions span the space. The driver
    holds ``MOST_DIRECTIONS`` vectors. A component is turned so that its largest loading is positive. Missing vectors are left out; one of another
    length, or with a missing number, is an error, as is ``k`` beyond the length.
    """
    vectors = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    mean = np.array([r["mean"] for r in sorted(mean_vector(vectors, "v").collect(), key=lambda r: r["dim"])])
    rows = vectors.count()
    if not rows:
        return None
    if not 0 < k <= len(mean):
        raise ValueError(f"vectors of {len(mean)} numbers have 1 to {len(mean)} components")
    width = min(len(mean), k + EXTRA)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(len(mean), width)))[0]
    basis, images = np.empty((len(mean), 0)), np.empty((len(mean), 0))
    for _ in range(MOST_ROUNDS):
        image = _times_covariance(vectors, rows, mean, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        found = basis @ turns[:, :k]
        miss = np.linalg.norm(images @ turns[:, :k] - found * values[:k], axis=0).max()
        if miss <= CLOSE * max(values[0], 0.0) or basis.shape[1] == len(mean):
            break
        rest = image - basis @ (basis.T @ image)
        rest -= basis @ (basis.T @ rest)
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        block = left[:, size > 1e-14 * values[0]][:, : len(mean) - basis.shape[1]]
        if not block.shape[1]:
            break
        if basis.shape[1] + block.shape[1] > max(MOST_DIRECTIONS, 4 * width):
            basis, images = basis @ turns[:, :width], images @ turns[:, :width]
        # Once more, since what is left can be small and so skew.
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    else:
        raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
    largest = found[np.abs(found).argmax(axis=0), np.arange(k)]
    return mean, found * np.where(largest < 0, -1.0, 1.0)


def pca_project(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """``key`` and the scores ``pc1``, ``pc2``, .. on the first ``k`` principal components of all rows with a vector, centred."""
    filled = df.filter(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>").alias("_v"))
    schema = T.StructType([df.schema[key], *(T.StructField(f"pc{i + 1}", T.DoubleType()) for i in range(k))])
    found = principal_components(df, vector, k)
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    mean, loadings = found
    shared = df.sparkSession.sparkContext.broadcast((mean, loadings))
    slices, names = _centred_slices(mean), schema.names

    def project(batches):
        import pyarrow

        origin, directions = shared.value
        for batch in batches:
            for start, x in slices(batch, 1, origin):
                scores = x @ directions
                own = batch.column(0).slice(start, len(x))
                yield pyarrow.RecordBatch.from_arrays([own, *(pyarrow.array(s) for s in scores.T.copy())], names=names)

    return filled.mapInArrow(project, schema)
