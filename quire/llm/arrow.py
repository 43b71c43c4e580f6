"""Rows of documents as Python values, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def groups_of(rows: Iterator[tuple], size_of, limit: int) -> Iterator[list[tuple]]:
    """Lists of rows, each ended by the row that fills ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def bounded(
    batches: Iterator[pa.RecordBatch], column: str, limit: int
) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``column`` of texts holds about ``limit`` bytes; one row at
    least, so a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            after = max(int(np.searchsorted(ends, before + limit, "right")), at + 1)
            yield batch.slice(at, after - at)
            at = after
