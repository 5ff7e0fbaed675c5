"""Vectors as whole numbers: which rows take part, and their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Squared length (in whole numbers) that a vector stays below, so that products and distances are exact.
LARGEST = 1 << 44


def whole(vector: Column, scale: int = 256) -> Column:
    """The components floor(scale * x) as array<int>; null where the vector or a component is null or not finite.

    A vector whose whole numbers have a squared length of 2^44 or more raises an error, as exact sums of them
    aren't sure; at a scale of 256 that is a length of 16,384.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    squares = F.aggregate(floors, F.lit(0.0), lambda s, x: s + x * x)
    exact = F.when(squares < LARGEST, F.transform(floors, lambda x: x.cast("int"))).otherwise(F.raise_error(F.lit("a vector is too long for exact sums")).cast("array<int>"))
    return F.when(vector.isNotNull() & F.coalesce(finite, F.lit(False)), exact)


def padded(v: Column, width: int) -> Column:
    """``v`` with zeros behind it, up to ``width`` components."""
    return F.when(F.size(v) == width, v).otherwise(F.concat(v, F.array_repeat(F.lit(0), F.lit(width) - F.size(v))))


def widest(vectors: DataFrame, column: str = "v") -> tuple[int, int]:
    """(rows, most components) of a checkpointed table."""
    found = vectors.agg(F.count("*"), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    return found[0], found[1]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` numbers, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
