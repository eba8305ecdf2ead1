"""Vectors of whole numbers: which rows take part, and products that are exact at any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1
LONG_MIN = -(1 << 63)
GREATEST = 2.0 ** 400  # a scaled component beyond it counts as it, so that no bound overflows


def valid_components(vector_col: str) -> Column:
    """True for a vector that is not NULL and holds no NULL, NaN or infinite component."""
    return F.col(vector_col).isNotNull() & F.forall(
        F.col(vector_col),
        lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")),
    )


def real_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``x`` (array of double) of the rows whose vector takes part, with the other columns as they are."""
    return vectors.where(valid_components(vector_col)).withColumns({
        "id": F.col(id_col).cast("long"), "x": F.transform(F.col(vector_col), lambda c: c.cast("double")),
    })


def whole_matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * component) as doubles that hold whole numbers; shorter vectors are filled up with zeros."""
    matrix = np.zeros((len(column), width))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    inside = np.arange(width) < lengths[:, None]
    matrix[inside] = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix * scale), -GREATEST, GREATEST)


def products(x: np.ndarray, q: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Inner products (long) of rows of whole numbers with ``q``; beyond a long the greatest or least long.

    No sum of some of the terms exceeds the product of the lengths, which tells
    whether doubles or longs hold all of them.  Other rows use unbounded numbers.
    """
    if lengths is None:
        lengths = np.sqrt((x * x).sum(axis=1))
    limit = lengths * np.sqrt(q @ q) * (1 + 1e-9)
    exact = limit < 2.0 ** 53
    if exact.all():
        return np.rint(x @ q).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    out[exact] = np.rint(x[exact] @ q).astype(np.int64)
    fits = ~exact & (limit < 2.0 ** 62)
    if fits.any():
        out[fits] = x[fits].astype(np.int64) @ q.astype(np.int64)
    mine = [int(c) for c in q] if not (exact | fits).all() else []
    for i in np.flatnonzero(~(exact | fits)).tolist():
        out[i] = min(max(sum(int(a) * b for a, b in zip(x[i].tolist(), mine)), LONG_MIN), LONG_MAX)
    return out


def packed(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())
