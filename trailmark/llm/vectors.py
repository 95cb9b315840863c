"""Integer vectors: what the vector operators of this package compute with."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: components are held within this distance of zero, so that squared distances of 64 of them fit a long
LARGEST = 1 << 26
#: largest component for which float64 products of up to 2^12 components are exact
EXACT = 1 << 20


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, number), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), held within LARGEST of zero."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("long"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A list column of whole vectors as rows of an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def squared_distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every point, as int64."""
    if max(np.abs(rows).max(initial=0), np.abs(points).max(initial=0)) < EXACT:
        a, b = rows.astype(np.float64), points.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((rows - p) ** 2).sum(1) for p in points], axis=1)


def floor_means(sums: DataFrame, keys: list[str], old: np.ndarray) -> np.ndarray:
    """Points moved to floor(sum / count) of their members; points without members stay.

    ``sums`` has the keys that place a component in ``old``, with partial
    ``total`` and ``members`` of each. Only one row per component reaches the driver.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    moved = old.copy()
    for r in sums.groupBy(*keys).agg(exact("total"), exact("members")).collect():
        if r["members"]:
            moved[tuple(r[k] for k in keys)] = int(r["total"]) // int(r["members"])
    return moved
