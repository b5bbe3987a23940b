"""Vectors between Spark arrays and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: Column, dim: int) -> Column:
    """True where the array has ``dim`` finite values that aren't all zero; never null."""
    finite = F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(col) == dim) & finite & F.exists(col, lambda v: v != 0), F.lit(False))


def matrix(col: pa.ChunkedArray | pa.Array, dim: int, dtype: type = np.float32) -> np.ndarray:
    """A column of lists, all of length ``dim``, as rows of a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float32()))
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=dtype).reshape(-1, dim)


def lists(rows: np.ndarray, kind: pa.DataType = pa.float32()) -> pa.ListArray:
    """Rows of a matrix as a column of lists."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).ravel(), kind))
