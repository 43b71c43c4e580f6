"""Single files by their path, from inside a task; any store that Arrow's file systems open."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = 8 << 20
EXPORTED = "path string, bytes long"


def open_store(path: str):
    """The file system of a path as Spark writes it, and the path inside it."""
    from pyarrow import fs
    if path.startswith("file:/"):
        # as it is: a name may hold what a URI would have to escape
        path = "/" + path.removeprefix("file:").lstrip("/")
    elif "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_path(path: str) -> bytes:
    store, place = open_store(path)
    with store.open_input_stream(place) as source:
        return source.readall()


def hash_path(path: str) -> str:
    """SHA-256 of a file of any length, a few megabytes at a time."""
    digest = hashlib.sha256()
    store, place = open_store(path)
    with store.open_input_stream(place) as source:
        while chunk := source.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def hashed_by_path(files: DataFrame) -> DataFrame:
    """Adds ``file_hash`` to ``files(path, …)``; null where a file cannot be read."""
    columns = files.columns

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for path in batch.column("path").to_pylist():
                try:
                    hashes.append(hash_path(path))
                except OSError:
                    hashes.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hashes, pa.string())], [*columns, "file_hash"])

    hashed = T.StructField("file_hash", T.StringType())
    schema = T.StructType([*files.schema.fields, hashed])
    return files.mapInArrow(stage, schema)


def export_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``rows(name, body)`` as files below ``folder``: one per name, which may have
    folders of its own and must be unique. Returns (path, bytes) of what was written.

    A task that is repeated writes the same files again.
    """
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        made: set[str] = set()
        for batch in batches:
            paths, sizes = [], []
            for name, body in zip(batch.column(0), batch.column(1)):
                name, body = name.as_py(), body.as_py()
                body = body.encode() if isinstance(body, str) else body or b""
                parent = f"{place}/{name}".rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(f"{place}/{name}") as out:
                    out.write(body)
                paths.append(f"{folder}/{name}")
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return rows.select("name", "body").mapInArrow(stage, EXPORTED)


def remove_paths(paths: DataFrame) -> DataFrame:
    """Deletes ``paths(path)``, files or whole folders, in tasks; returns ``path, removed``.

    What cannot be deleted stays and is not ``removed``; what is not there any more is. So a
    task that is repeated gives the same rows. Nothing is deleted before the result is read.
    """
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        for batch in batches:
            removed = []
            for path in batch.column(0).to_pylist():
                try:
                    store, place = open_store(path)
                    kind = store.get_file_info(place).type
                    if kind == fs.FileType.Directory:
                        store.delete_dir(place)
                    elif kind != fs.FileType.NotFound:
                        store.delete_file(place)
                    removed.append(True)
                except (OSError, TypeError, AttributeError):
                    removed.append(False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.bool_())], ["path", "removed"])

    return paths.select("path").mapInArrow(stage, "path string, removed boolean")
