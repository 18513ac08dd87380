"""Arrow batches in parts of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel holds as Python objects at once; one longer text is a part of its own.
PART = 2_000_000
_forget: list[Callable[[], None]] = []


def forgettable(forget: Callable[[], None]) -> None:
    """Register what empties a module's models that a worker keeps between tasks."""
    _forget.append(forget)


def release() -> None:
    """Forget the models that this worker keeps and give free memory back to the system: workers go from one operator to the next."""
    for forget in _forget:
        forget()
    trim()


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def parts(batch: pa.RecordBatch, column: int, limit: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` (no copies) of whole rows, each of at most ``limit`` bytes in its string or binary column, or of one row."""
    if not batch.num_rows:
        return
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(size) - size
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(before + size, before[at] + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
