"""Pairwise second moments of many columns in one pass.

Each Arrow batch gives four p x p blocks by matrix products: pair counts, means,
squares and products about the means, over the rows where both columns are
present.  Blocks are merged by the update for shifted moments (Chan, Golub &
LeVeque 1983) inside a task, then over the tasks in two steps of grouped merges,
so that no step holds more than a few blocks at a time.  The result is a plan: no
job runs while it is built.

Null and NaN are missing.  A column without variation has squares of exactly 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: groups of the first merge
FAN = 64


def block(x: np.ndarray) -> np.ndarray:
    """(n, mean, squares, products) by pair of columns: [1][i, j] is the mean of column i
    over the rows that also have j."""
    there = ~np.isnan(x)
    first = np.array([c[m][0] if m.any() else 0.0 for c, m in zip(x.T, there.T)])
    v = np.where(there, x - first, 0.0)
    m = there.astype(np.float64)
    n, s, q, c = m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v
    some = np.maximum(n, 1)
    return np.stack([n, np.where(n > 0, first[:, None] + s / some, 0.0), np.maximum(q - s * s / some, 0.0), c - s * s.T / some])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    d, w = b[1] - a[1], a[0] * b[0] / some
    d = np.where(w > 0, d, 0.0)
    mean = np.where(a[0] > 0, a[1] + d * b[0] / some, b[1])
    return np.stack([n, mean, a[2] + b[2] + d * d * w, a[3] + b[3] + d * d.T * w])


def from_moments(df: DataFrame, cols: Sequence[str], result: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``result`` makes of the moments of all rows."""
    p = len(cols)
    kind = "part int, state array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        state = np.zeros((4, p, p))
        for batch in batches:
            if batch.num_rows:
                state = merge(state, block(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % FAN], pa.int32()), pa.array([state.ravel().tolist()], pa.list_(pa.float64()))],
            ["part", "state"])

    def whole(f: pd.DataFrame) -> np.ndarray:
        state = np.zeros((4, p, p))
        for s in f.state:
            state = merge(state, np.asarray(s).reshape(4, p, p))
        return state

    def half(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [0], "state": [whole(f).ravel().tolist()]})

    values = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    none = df.sparkSession.createDataFrame([(0, [0.0] * (4 * p * p))], kind)
    states = values.mapInArrow(partial, kind).union(none)
    return states.groupBy("part").applyInPandas(half, kind).groupBy("part").applyInPandas(lambda f: result(whole(f)), schema)
