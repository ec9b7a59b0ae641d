"""Vectors as exact integers, from Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a component is multiplied by before it's rounded down, and the bound that rounded components stay under: so a
#: squared distance or an inner product of up to 128 components is a long.
SCALE, MOST = 256, 1 << 27


def one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def integers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(SCALE * x) of every component laid end to end, the rows' offsets into them, and whether a row counts: its
    vector isn't null and no component is null, NaN, infinite or out of range."""
    column = one(column)
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null turns NaN
    fine = np.abs(x) < MOST / SCALE
    wrong = np.concatenate([[0], np.cumsum(~fine)])
    ok = (wrong[at[1:]] == wrong[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    return np.floor(np.where(fine, x, 0.0) * SCALE).astype(np.int64), at, ok


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)[: len(rows) + 1]), pa.array(rows.ravel()))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of dim numbers each as rows."""
    return one(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def padded(x: np.ndarray, at: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
    """Some rows of ragged vectors as a matrix: what a vector lacks counts as zero, what it has beyond dim is left out."""
    out = np.zeros((len(rows), dim), np.int64)
    size = np.minimum(at[rows + 1] - at[rows], dim)
    if len(rows) and (size == dim).all():
        return x[at[rows][:, None] + np.arange(dim)]
    for n in np.unique(size).tolist():
        some = size == n
        out[some, :n] = x[at[rows[some]][:, None] + np.arange(n)]
    return out
