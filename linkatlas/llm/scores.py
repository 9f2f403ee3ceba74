"""Exact integer inner products of vectors of whole numbers kept as doubles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 2 ** 63 - 1
# Beyond 2^52 a double has no fraction.
WHOLE = float(2 ** 52)
GREATEST = float(np.finfo(np.float64).max)


def is_finite_vector(value: Column) -> Column:
    """False for null vectors and for those that hold a null, NaN or infinite component."""
    return F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_components(value: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as a double; what passes a double's range becomes the greatest double."""
    def whole(x: Column) -> Column:
        y = F.least(F.greatest(x * scale, F.lit(-GREATEST)), F.lit(GREATEST))
        return F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).otherwise(y)

    return F.transform(value, whole)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` as 64-bit integers, exact; what passes 64 bits becomes the greatest or least of them (``TOP``, ``-TOP``).

    Rows whose products stay below 2^53 go through floating-point products, those below 2^62 through 64-bit ones, and only the rest through
    Python's integers.
    """
    width = a.shape[1]
    high_a, high_b = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    with np.errstate(over="ignore"):
        reach = high_a.max(initial=0) * high_b.max(initial=0) * width
    if reach < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    fits_a, fits_b = high_a < 2.0 ** 62, high_b < 2.0 ** 62
    if reach < 2.0 ** 62 and fits_a.all() and fits_b.all():
        return a.astype(np.int64) @ b.astype(np.int64).T
    # Rows of usual size meet each other without big integers.
    small_a, small_b = high_a <= 2.0 ** 23, high_b <= 2.0 ** 53 / width / max(1.0, float(high_a[high_a <= 2.0 ** 23].max(initial=1)))
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(small_a, small_b)] = (a[small_a] @ b[small_b].T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(len(m), width)
    for rows, cols in ((~small_a, np.ones(len(b), bool)), (small_a, ~small_b)):
        if rows.any() and cols.any():
            out[np.ix_(rows, cols)] = np.clip(big(a[rows]) @ big(b[cols]).T, -TOP, TOP).astype(np.int64)
    return out
