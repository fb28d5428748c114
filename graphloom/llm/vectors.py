"""Embedding columns in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """A list<float or double> column as one array per row; None where the list or a component is null."""
    if not len(column):
        return []
    values = column.flatten()
    if not column.null_count and not values.null_count:
        flat = values.to_numpy(zero_copy_only=False)
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        return np.split(flat, ends[:-1])
    out: list[np.ndarray | None] = []
    for x in column:
        own = x.values if x.is_valid else None
        out.append(None if own is None or own.null_count else own.to_numpy(zero_copy_only=False))
    return out


def finite(row: np.ndarray | None) -> bool:
    return row is not None and bool(np.isfinite(row).all())
