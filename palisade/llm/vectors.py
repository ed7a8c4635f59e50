"""Vectors of integers: which rows have one, and exact arithmetic on blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubles hold every integer up to this; int64 products and sums are safe up to the other.
EXACT, SAFE = 1 << 53, 1 << 62
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


def usable(vector: str | Column) -> Column:
    """True for a vector that is not null and has no null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double"))
    return F.coalesce(F.forall(v, fine), F.lit(False))


def integers(vector: str | Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles (which are integers beyond 2^52 anyway)."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(v, whole)


def matrix(lists: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """A list column as rows of equal length, shorter ones padded with zeros (to ``dim`` at least)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = max(int(sizes.max(initial=0)), dim or 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def padded(rows: np.ndarray, dim: int) -> np.ndarray:
    return rows if rows.shape[1] >= dim else np.hstack([rows, np.zeros((len(rows), dim - rows.shape[1]))])


def python_integers(rows: np.ndarray) -> np.ndarray:
    """The same integers without a bound (an object array)."""
    return np.array([[int(x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def clipped(numbers: np.ndarray) -> np.ndarray:
    """Python integers as 64-bit ones; what is beyond them counts as the nearest."""
    return np.array([min(max(x, LEAST), MOST) for x in numbers.ravel().tolist()], np.int64).reshape(numbers.shape)


def largest(rows: np.ndarray) -> float:
    return float(np.abs(rows).max(initial=0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exact: a double GEMM where nothing can round."""
    bound = largest(a) * largest(b) * max(1, a.shape[1])
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    if bound < SAFE:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return clipped(python_integers(a) @ python_integers(b).T)


def blocks(parts: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows."""
    for batch in parts:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
