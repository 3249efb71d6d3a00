"""Helpers for functions that Spark runs over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa

BATCH_BYTES = 4 * 2 ** 20
FILE_BYTES = 64 * 2 ** 20


def by_bytes(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose texts together hold about ``most`` bytes, so that a batch
    of long texts is not worked on at once."""
    start = held = 0
    for i, n in enumerate(map(_size, batch.column(column))):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _size(value: pa.Scalar) -> int:
    return len(value.as_buffer()) if value.is_valid else 0


def small_file(path: str, most: int = FILE_BYTES) -> bytes:
    """A file to send to all executors; its size is checked."""
    data = Path(path)
    if data.stat().st_size > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return data.read_bytes()
