"""What the operators on vectors share: which vectors count, integer components, and Arrow lists as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(c: Column) -> Column:
    """True for a vector that has components, all of them finite."""
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(c: Column, scale: int) -> Column:
    """Components as ``floor(scale * x)``, multiplied as doubles."""
    return F.transform(c, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, one row after another, and the length of each row."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, width: int, dtype: type = np.float64) -> np.ndarray:
    """A list column as rows of ``width`` numbers; shorter rows are filled with zeros."""
    values, lengths = flat(column)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width).astype(dtype)
    out = np.zeros((len(lengths), width), dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out
