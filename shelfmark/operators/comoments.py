"""Co-moments of pairs of columns, by blocks of columns, merged with their means."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import scratch_path

BLOCK = 128  # columns of a block; a task holds eight numbers for each pair of two blocks
_PARTIAL = (
    "a int, b int, n double, mean_a double, mean_b double, m_aa double, m_bb double, m_ab double, "
    "low_a double, high_a double, low_b double, high_b double"
)


def _task_sums(left: Sequence[int], right: Sequence[int]) -> Callable:
    """A function that sums up one task's rows into one row per pair of ``left`` and ``right``.

    Columns are named by number. It carries all it needs with it, so workers do not need this package.
    """
    left, right = list(left), list(right)

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        names = sorted({*left, *right})
        at = {name: i for i, name in enumerate(names)}
        rows, cols = [at[a] for a in left], [at[b] for b in right]
        shape = (len(rows), len(cols))
        n = np.zeros(shape)
        mean_a, mean_b, m_aa, m_bb, m_ab = (np.zeros(shape) for _ in range(5))
        low_a, low_b = np.full(shape, np.inf), np.full(shape, np.inf)
        high_a, high_b = np.full(shape, -np.inf), np.full(shape, -np.inf)
        for batch in batches:
            x = np.column_stack([batch.column(str(c)).to_numpy(zero_copy_only=False) for c in names]).astype(float)
            there = np.isfinite(x)
            # Columns with the same values missing share their rows, so all pairs of two such groups are one product.
            groups: dict[bytes, list[int]] = {}
            for i in range(len(names)):
                groups.setdefault(there[:, i].tobytes(), []).append(i)
            members = [np.array(g) for g in groups.values()]
            for p in members:
                at_a = np.flatnonzero(np.isin(rows, p))
                if not len(at_a):
                    continue
                for q in members:
                    at_b = np.flatnonzero(np.isin(cols, q))
                    both = there[:, p[0]] & there[:, q[0]]
                    count = float(both.sum())
                    if not len(at_b) or not count:
                        continue
                    xa = x[np.ix_(both, np.take(rows, at_a))]
                    xb = x[np.ix_(both, np.take(cols, at_b))]
                    # The values less one of them, so that equal values give exact zeros.
                    ca, cb = xa - xa[0], xb - xb[0]
                    off_a, off_b = ca.mean(axis=0), cb.mean(axis=0)
                    ca, cb = ca - off_a, cb - off_b
                    new_a, new_b = (xa[0] + off_a)[:, None], (xb[0] + off_b)[None, :]
                    here = np.ix_(at_a, at_b)
                    old = n[here]
                    share = count / (old + count)
                    # The means of no rows are nought, and weigh nothing.
                    step_a, step_b = new_a - mean_a[here], new_b - mean_b[here]
                    weight = old * share
                    m_aa[here] += (ca * ca).sum(axis=0)[:, None] + step_a * step_a * weight
                    m_bb[here] += (cb * cb).sum(axis=0)[None, :] + step_b * step_b * weight
                    m_ab[here] += ca.T @ cb + step_a * step_b * weight
                    mean_a[here] = np.where(old > 0, mean_a[here] + step_a * share, new_a)
                    mean_b[here] = np.where(old > 0, mean_b[here] + step_b * share, new_b)
                    n[here] = old + count
                    low_a[here] = np.minimum(low_a[here], xa.min(axis=0)[:, None])
                    high_a[here] = np.maximum(high_a[here], xa.max(axis=0)[:, None])
                    low_b[here] = np.minimum(low_b[here], xb.min(axis=0)[None, :])
                    high_b[here] = np.maximum(high_b[here], xb.max(axis=0)[None, :])
        i, j = np.nonzero(n)
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.take(left, i).astype("int32")), pa.array(np.take(right, j).astype("int32")),
                    *(pa.array(m[i, j]) for m in (n, mean_a, mean_b, m_aa, m_bb, m_ab, low_a, high_a, low_b, high_b)),
                ],
                names=["a", "b", "n", "mean_a", "mean_b", "m_aa", "m_bb", "m_ab", "low_a", "high_a", "low_b", "high_b"],
            )

    return sums


def comoments(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``(a, b, n, m_aa, m_bb, m_ab, varies)`` for each pair of columns with rows that have both, ``a`` before or equal to ``b``.

    ``a`` and ``b`` are places in ``columns``. ``n`` counts the rows with both values, ``m_aa``, ``m_bb`` and ``m_ab``
    are sums of squares and products of what lies between these rows' values and their means, and ``varies`` says whether both columns have
    two different values there. Nulls, NaN and infinite values are missing. A pair's moments come only from its
    rows, batch by batch and task by task around means of their own, so large means and gaps cost no digits. Each pair of blocks
    reads its own columns only. A task gives one row per pair; these are written to the scratch folder, since merging needs first the
    means of all rows and then the distance of each task's mean to them.
    """
    blocks = [range(i, min(i + block, len(columns))) for i in range(0, len(columns), block)]
    parts = []
    for left, right in itertools.combinations_with_replacement(blocks, 2):
        needed = sorted({*left, *right})
        values = df.select(*(F.col(columns[i]).cast("double").alias(str(i)) for i in needed))
        parts.append(values.mapInArrow(_task_sums(left, right), _PARTIAL).filter("a <= b"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    path = scratch_path(df.sparkSession, "comoments")
    whole.write.parquet(path)
    tasks = df.sparkSession.read.schema(_PARTIAL).parquet(path)

    def mean(of: str) -> Column:
        return F.sum(F.col("n") * F.col(of)) / F.sum("n")

    # Sums around the mean of the tasks' means first: its own error is then squared, and so vanishes.
    means = tasks.groupBy("a", "b").agg(mean("mean_a").alias("all_a"), mean("mean_b").alias("all_b"))
    off_a, off_b = F.col("mean_a") - F.col("all_a"), F.col("mean_b") - F.col("all_b")
    apart = (F.min("low_a") < F.max("high_a")) & (F.min("low_b") < F.max("high_b"))
    return tasks.join(means, ["a", "b"]).groupBy("a", "b").agg(
        F.sum("n").cast("long").alias("n"),
        F.sum(F.col("m_aa") + F.col("n") * off_a * off_a).alias("m_aa"),
        F.sum(F.col("m_bb") + F.col("n") * off_b * off_b).alias("m_bb"),
        F.sum(F.col("m_ab") + F.col("n") * off_a * off_b).alias("m_ab"),
        apart.alias("varies"),
    )
