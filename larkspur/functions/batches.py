"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2 << 20  # text that a task holds as Python strings at a time


def byte_runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[pa.Array]:
    """A text column cut into runs of rows of about ``limit`` bytes, in order; a longer text is a run of its own."""
    if not len(texts):
        yield texts
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    ends = np.cumsum(np.asarray(sizes.to_numpy(zero_copy_only=False), np.int64) + 16)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop
