"""Vector columns as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in the column.

    Rows whose vector is null, or has a null or non-finite component, are left out.
    """
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.maximum(size, 0)
    begin = np.cumsum(held) - held
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    sound = (size >= 0) & (bad[begin + held] == bad[begin])
    for length in np.unique(size[sound]).tolist():
        rows = np.flatnonzero(sound & (size == length))
        yield rows, flat[begin[rows][:, None] + np.arange(length)]
