"""Arrow lists of numbers as numpy matrices and back, without Python objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, width) float64 matrix of a column of equally long vectors; a null entry is NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def vectors(rows: np.ndarray) -> pa.ListArray:
    """A column of the matrix's rows."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))
