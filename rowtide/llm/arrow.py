"""Helpers for Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Models and caches that a worker keeps between tasks.
CACHES: list[dict] = []


def only(*kept: dict) -> None:
    """Drop what a worker keeps for other operators: workers are used again, and their memory adds up."""
    dropped = [cache for cache in CACHES if cache and not any(cache is k for k in kept)]
    for cache in dropped:
        cache.clear()
    if dropped:
        trim()


def trim() -> None:
    """Give memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, name: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a text column, so that what is made of them stays small."""
    sizes = pc.fill_null(pc.binary_length(column_of(batch, name)), 0).to_pylist()
    for begin, end in cut(sizes, most):
        yield batch.slice(begin, end - begin)


def cut(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to about ``most``; one that is larger stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 of every i, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total, dtype=np.int64)


def binary_array(flat: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the slices of flat between byte offsets."""
    flat = np.ascontiguousarray(flat)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
