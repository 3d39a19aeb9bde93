"""Arrow columns as NumPy arrays, with the checks that a silent reshape would skip."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, what: str = "vectors", finite: bool = False) -> np.ndarray:
    """Lists of equal length as rows of doubles; null lists, null values or unequal lengths are errors.

    With `finite`, NaN and infinities are errors too: one of them would spoil every sum it enters.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        raise ValueError(f"{column.null_count} of {n} {what} are null; remove such rows first (qc.drop_nan_rows)")
    widths = np.unique(column.value_lengths().to_numpy())
    if len(widths) > 1:
        raise ValueError(f"{what} have {len(widths)} different lengths, from {widths[0]} to {widths[-1]}")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError(f"{flat.null_count} values in {what} are null; remove such rows first (qc.drop_nan_rows)")
    out = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, int(widths[0]) if len(widths) else 0)
    if finite and not np.isfinite(out).all():
        raise ValueError(f"{int((~np.isfinite(out).all(axis=1)).sum())} of {n} {what} hold NaN or infinity; remove such rows first (qc.drop_nan_rows)")
    return out


def key_groups(columns: list[pa.Array], n: int) -> list[tuple[tuple, np.ndarray]]:
    """Row numbers by key, keys as tuples of Python values; one tuple of all rows without key columns."""
    if not columns:
        return [((), np.arange(n))]
    codes = np.zeros(n, np.int64)
    for column in columns:
        encoded = column.dictionary_encode(null_encoding="encode")
        codes = codes * len(encoded.dictionary) + encoded.indices.to_numpy()
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(inverse))[:-1])
    return [(tuple(c[int(f)].as_py() for c in columns), rows) for f, rows in zip(first, parts)]
