"""Vectors as whole numbers: shared by the exact search and the code compression.

A component x becomes floor(scale * x); beyond +-2**24 it is held at that limit, so
that sums of products stay inside 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE, LIMIT = 256, 1 << 24
# Whole numbers below this are exact in a double, whatever the order of additions.
EXACT = 1 << 53


def complete(vector: str) -> Column:
    """Whether a vector is given and all its components are finite numbers; an empty one is."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(vector: str, scale: int = SCALE) -> Column:
    """Components as whole numbers, rounded down."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def number_type(*matrices: np.ndarray) -> type:
    """A type in which the products of these matrices are exact: double if its digits reach, else 64-bit."""
    reach = matrices[0].shape[-1]
    for m in matrices:
        reach *= int(np.abs(m).max(initial=0))
    return np.float64 if reach < EXACT else np.int64
