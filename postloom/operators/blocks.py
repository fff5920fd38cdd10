"""Vectors of one Arrow batch as a matrix, for numpy work inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

# Largest table this package copies to every executor, in bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, width) in double precision; all vectors must have one width."""
    n = len(column)
    if n == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width, rest = divmod(len(flat), n)
    lengths = np.diff(column.offsets.to_numpy())
    if rest or (lengths != width).any():
        raise ValueError("vectors differ in width")
    return flat.reshape(n, width)


def collect_small(df: DataFrame, max_rows: int) -> list[Row] | None:
    """All rows when there are at most ``max_rows``, else None. Never reads more."""
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else rows
