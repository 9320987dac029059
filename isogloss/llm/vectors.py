"""Vectors with whole numbers as components, for operators that assign them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components' greatest size: squared distances of up to 128 of them fit 64 bits.
LARGEST = 1 << 27


def finite(v: Column) -> Column:
    """Whether an array is not null and has no null or non-finite component."""
    # A null component or a NaN makes the test null or false.
    return v.isNotNull() & F.coalesce(F.forall(v, lambda c: F.abs(c) < float("inf")) & ~F.exists(v, F.isnan), F.lit(False))


def rows_of(vectors: DataFrame, id_col: str, vec_col: str, *further: Column) -> DataFrame:
    """id (long) and v (array<double>) of each row, and further columns; no other column is read."""
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"), *further)


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v) as 64-bit numbers. Components over LARGEST in size are an error, as distances would not fit."""
    out = np.floor(v * scale)
    if len(out) and np.abs(out).max(initial=0) > LARGEST:
        raise ValueError(f"a component times {scale} is over {LARGEST}")
    return out.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to c, a row or as many rows."""
    away = x - c
    return np.einsum("nd,nd->n", away, away)


def mean_floor(sums: list[int], n: int) -> list[int]:
    """The componentwise floor of sums / n."""
    return [s // n for s in sums]
