"""A stream of the files of a folder that are new or were changed in place."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quire.sources.files import open_store

FILES = "path string, modificationTime timestamp, length long"
TASK_FILES = 2000
KEPT_DIFFERENCES = 32

_SEEN = pa.schema([
    ("path", pa.string()), ("time", pa.int64()), ("length", pa.int64()), ("gone", pa.bool_())])


class ChangedFiles(DataSource):
    """Options: ``path``, the folder; ``state``, a folder of the stream's own on shared
    storage; ``files_per_batch``."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return FILES

    def streamReader(self, schema) -> ChangedFilesReader:
        return ChangedFilesReader(self.options)


class Slice(InputPartition):
    """Some rows of one difference."""

    def __init__(self, number: int, first: int, rows: int):
        self.number, self.first, self.rows = number, first, rows


class ChangedFilesReader(DataSourceStreamReader):
    """An offset is the number of a difference: the files whose length or time is not as it
    was when the folder was last listed. Differences are written before Spark is told of
    them, so a batch that is repeated reads the same files, and a stream that starts anew
    goes on from what was written. All differences together, merged from time to time, are
    what is known of the folder."""

    def __init__(self, options):
        self.folder, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.most = int(options.get("files_per_batch", 10_000))

    def initialOffset(self) -> dict:
        return {"difference": 0}

    def latestOffset(self) -> dict:
        number, known = self._known()
        now = self._listed()
        rows = [(path, time, length, False) for path, (time, length) in now.items()
                if known.get(path) != (time, length)]
        rows.sort(key=lambda row: (row[1], row[0]))
        # what is gone may come back as it was, and is new then
        rows += [(path, None, None, True) for path in known.keys() - now.keys()]
        for at in range(0, len(rows), self.most):
            number += 1
            self._write(f"{number:012d}", rows[at:at + self.most])
        return {"difference": number}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        slices = []
        for number in range(start["difference"] + 1, end["difference"] + 1):
            rows = self._read(f"{number:012d}").num_rows
            slices += [Slice(number, at, min(TASK_FILES, rows - at))
                       for at in range(0, rows, TASK_FILES)]
        return slices

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        table = self._read(f"{partition.number:012d}").slice(partition.first, partition.rows)
        table = table.filter(pa.compute.invert(table["gone"]))
        times = pa.compute.cast(table["time"], pa.timestamp("us", "UTC"))
        found = pa.table([table["path"], times, table["length"]],
                         ["path", "modificationTime", "length"])
        yield from found.to_batches()

    def commit(self, end: dict) -> None:
        """Merges differences that no batch reads again into the state of the folder."""
        names = self._names()
        done = [n for n in names if n.isdigit() and int(n) <= end["difference"]]
        if len(done) < KEPT_DIFFERENCES:
            return
        known = self._merged([n for n in names if not n.isdigit()] + done)
        self._write(f"all-{int(done[-1]):012d}", [(p, *seen, False) for p, seen in known.items()])
        store, place = open_store(self.state)
        for name in names:
            if name in done or (not name.isdigit() and name < f"all-{int(done[-1]):012d}"):
                store.delete_file(f"{place}/{name}.parquet")

    # -- the folder and what is known of it ------------------------------------

    def _listed(self) -> dict[str, tuple[int, int]]:
        from pyarrow import fs
        store, place = open_store(self.folder)
        found = store.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
        listed = {}
        for file in found:
            inside = file.path.removeprefix(place).strip("/")
            if file.type != fs.FileType.File or _hidden(inside):
                continue
            # milliseconds, as Spark's own scan gives them
            time = file.mtime_ns // 1_000_000 * 1000
            listed[f"{_prefix(self.folder)}/{inside}"] = (time, file.size)
        return listed

    def _known(self) -> tuple[int, dict[str, tuple[int, int]]]:
        names = self._names()
        number = max((int(name.removeprefix("all-")) for name in names), default=0)
        whole = [name for name in names if not name.isdigit()][-1:]
        after = int(whole[0].removeprefix("all-")) if whole else 0
        return number, self._merged(
            whole + [name for name in names if name.isdigit() and int(name) > after])

    def _merged(self, names: list[str]) -> dict[str, tuple[int, int]]:
        known: dict[str, tuple[int, int]] = {}
        for name in names:
            columns = (self._read(name)[c].to_pylist() for c in _SEEN.names)
            for path, time, length, gone in zip(*columns):
                if gone:
                    known.pop(path, None)
                else:
                    known[path] = (time, length)
        return known

    def _names(self) -> list[str]:
        """Differences by number and, behind them, states of the whole folder by number."""
        from pyarrow import fs
        store, place = open_store(self.state)
        found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
        names = [posixpath.basename(file.path) for file in found]
        return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))

    def _read(self, name: str) -> pa.Table:
        from pyarrow import parquet
        store, place = open_store(self.state)
        return parquet.read_table(f"{place}/{name}.parquet", filesystem=store)

    def _write(self, name: str, rows: list[tuple]) -> None:
        """Under another name first: a file is there as a whole or not at all."""
        from pyarrow import parquet
        store, place = open_store(self.state)
        store.create_dir(place, recursive=True)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _SEEN)] if rows else [
            pa.array([], f.type) for f in _SEEN]
        parquet.write_table(
            pa.table(columns, schema=_SEEN), f"{place}/{name}.unfinished", filesystem=store)
        store.move(f"{place}/{name}.unfinished", f"{place}/{name}.parquet")


def _hidden(inside: str) -> bool:
    return any(part.startswith((".", "_")) for part in inside.split("/"))


def _prefix(folder: str) -> str:
    """How Spark writes the paths below a folder."""
    if "://" in folder or folder.startswith("file:"):
        return folder.replace("file:///", "file:/")
    return f"file:{folder}"


def changed_documents(
    spark: SparkSession, folder: str, state: str, files_per_batch: int = 10_000
) -> DataFrame:
    """``path, modificationTime, length`` of the files below ``folder`` that are new or whose
    length or time is another than before; each state of a file is delivered once.

    ``state`` is a folder of this stream on shared storage and belongs to its checkpoint. The
    driver lists the folder, as it does for Spark's own file streams, and holds a few dozen
    bytes per file meanwhile. Contents are not read: ``start_workspace`` opens them by path.
    """
    spark.dataSource.register(ChangedFiles)
    return (
        spark.readStream.format("changed_files").option("path", folder).option("state", state)
        .option("files_per_batch", files_per_batch).load())
