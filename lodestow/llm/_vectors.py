"""Vectors as Arrow tasks see them: which rows hold a usable vector, and the rows of a batch as one matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Neither null nor with a null, infinite or NaN component; a vector without components is finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def width(rows: DataFrame, vector: str = "embedding") -> int:
    """Components of the longest usable vector; 0 without one."""
    return rows.where(finite(F.col(vector))).agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """float64, a row for each vector; shorter vectors end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out
