"""EPUB containers exploded to one row per item."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.batches import batches
from quire.functions.epub import read_epub
from quire.schemas import EPUB_ITEM


def epub_items(docs: DataFrame, order: str = "manifest") -> DataFrame:
    """Items of ``docs(path, content)``; an unreadable container is one error row."""
    schema = to_arrow_schema(EPUB_ITEM)

    def rows(incoming: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in incoming:
            for path, content in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                try:
                    _, items = read_epub(content, order)
                except Exception as problem:
                    yield {"path": path, "error": str(problem)}
                    continue
                for pos, (name, kind, body) in enumerate(items):
                    yield {"path": path, "item_pos": pos, "name": name, "kind": kind, "body": body}

    def stage(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(rows(incoming), schema, size_of=lambda row: len(row.get("body") or b""))

    return docs.select("path", "content").mapInArrow(stage, EPUB_ITEM)
