"""Arrow batches in slices of bounded bytes: what a Python worker holds does not depend on how long its texts are."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

GIVE_BACK_BYTES = 8 << 20


def give_back() -> None:
    """Return free memory to the system: a Python worker outlives its task, and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: larger blocks are mapped, and go as soon as they are freed
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def rows_of(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``max_bytes`` of ``column`` at most (one row at least); free memory goes back at both ends and now and then."""
    give_back()
    used = 0
    for part in _slices(batches, column, max_bytes):
        size = part.nbytes
        yield part
        used += size
        if used >= GIVE_BACK_BYTES:
            del part
            give_back()
            used = 0
    give_back()


def cuts(texts: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts holding about ``max_bytes`` at most, one text at least."""
    start = used = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and used + n > max_bytes:
            yield start, i - start
            start, used = i, 0
        used += n
    if len(texts):
        yield start, len(texts) - start


def _slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, length in cuts(batch.column(batch.schema.get_field_index(column)), max_bytes):
            yield batch.slice(start, length)
