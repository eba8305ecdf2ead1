"""Helpers for functions that run over Arrow record batches in Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # text handled at once inside a task


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``limit`` bytes of text.

    Every row comes out once, in order; a single longer text is a run of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes.to_numpy(zero_copy_only=False), np.int64) + 16)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, NULL as the empty text."""
    return [text or "" for text in batch.column(column).to_pylist()]


def groups_in(
    batches: Iterator[pa.RecordBatch], key: str
) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Walk batches sorted by an integer ``key`` and give each key with its row runs.

    The runs of a key come as a stream, so a key of any size needs the memory
    of one batch only.  A key's runs must be read before the next key is asked for.
    """
    held: list[pa.RecordBatch] = []

    def pull() -> bool:
        while not held:
            batch = next(batches, None)
            if batch is None:
                return False
            if batch.num_rows:
                held.append(batch)
        return True

    def runs(group: int) -> Iterator[pa.RecordBatch]:
        while pull():
            batch = held[0]
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            stop = int(np.searchsorted(keys, group, "right"))
            if not stop:
                return
            held.clear()
            if stop < batch.num_rows:
                held.append(batch.slice(stop))
            yield batch.slice(0, stop)
            if stop < batch.num_rows:
                return

    batches = iter(batches)
    while pull():
        group = held[0].column(key)[0].as_py()
        own = runs(group)
        yield group, own
        for _rest in own:
            pass


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of equally long packed rows (binary) as a matrix of bytes."""
    if not len(column):
        return np.empty((0, 0), np.uint8)
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(len(column), -1)
