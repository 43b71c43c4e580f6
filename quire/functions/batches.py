"""Arrow batches that stay small although a row may hold a whole document."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

MAX_ROWS = 256
MAX_BYTES = 32 << 20


def batches(
    rows: Iterable[dict], schema: pa.Schema, size_of: Callable[[dict], int]
) -> Iterator[pa.RecordBatch]:
    waiting: list[dict] = []
    held = 0
    for row in rows:
        waiting.append(row)
        held += size_of(row)
        if len(waiting) >= MAX_ROWS or held >= MAX_BYTES:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting, held = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)
