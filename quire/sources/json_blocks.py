"""One large JSON object in parallel: the members of its inner objects as rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.batches import batches
from quire.operators.skew import cut_lineage
from quire.sources.files import open_store

BLOCK_BYTES = 2 << 20
_BACK = 64
_NAME = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', re.DOTALL)

_SUMS = "path string, block long, length long, quotes int, outside long, inside long"
_MEMBERS = "path string, block long, kind string, name string, text string"
_MEMBER_SCHEMA = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("name", pa.string()),
    ("text", pa.string())])


class _File:
    """Byte ranges of one file."""

    def __init__(self, path: str):
        store, place = open_store(path)
        self.source = store.open_input_file(place)
        self.length = self.source.size()

    def read(self, start: int, size: int) -> bytes:
        return self.source.read_at(min(size, self.length - start), start)

    def escapes(self, start: int) -> int:
        """The number of backslashes right before a place."""
        back = _BACK
        while True:
            data = self.read(max(start - back, 0), min(back, start))
            count = len(data) - len(data.rstrip(b"\\"))
            if count < len(data) or len(data) == start:
                return count
            back *= 2


def _marks(data: bytes, escapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, which of them are quotes that open or close a string, and how many of those
    there are up to each byte."""
    raw = np.frombuffer(data, np.uint8)
    place = np.arange(len(raw))
    other = np.maximum.accumulate(np.where(raw != 0x5C, place, -1 - escapes))
    before = np.concatenate([[-1 - escapes], other[:-1]]) if len(raw) else other
    quotes = (raw == 0x22) & ((place - 1 - before) % 2 == 0)
    return raw, quotes, np.cumsum(quotes)


def _steps(raw: np.ndarray) -> np.ndarray:
    up = (raw == 0x7B) | (raw == 0x5B)
    return up.astype(np.int64) - ((raw == 0x7D) | (raw == 0x5D))


def _sum_stage(block_bytes: int):
    """What a block does to the state before it: quotes it holds, and how much deeper it ends
    if it starts outside of a string, or inside of one."""

    def stage(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for row in batch.to_pylist():
                file = _File(row["path"])
                start = row["block"] * block_bytes
                raw, _, upto = _marks(file.read(start, block_bytes), file.escapes(start))
                steps, odd = _steps(raw), upto % 2 == 1
                yield pa.RecordBatch.from_pylist([row | {
                    "length": file.length, "quotes": int(upto[-1]) if len(upto) else 0,
                    "outside": int(steps[~odd].sum()), "inside": int(steps[odd].sum())}],
                    schema=pa.schema([
                        ("path", pa.string()), ("block", pa.int64()), ("length", pa.int64()),
                        ("quotes", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())]))

    return stage


class _Scan:
    """Reads on from a place with a known state: whether it is in a string, and how deep."""

    def __init__(self, file: _File, start: int, in_string: bool, depth: int):
        self.file, self.at, self.in_string, self.depth = file, start, in_string, depth

    def next(self, size: int):
        """The next bytes and, per byte, whether it is outside of strings and the depth
        behind it."""
        data = self.file.read(self.at, size)
        raw, quotes, upto = _marks(data, self.file.escapes(self.at))
        free = ((upto + self.in_string) % 2 == 0) & ~quotes
        depths = self.depth + np.cumsum(np.where(free, _steps(raw), 0))
        if len(raw):
            self.at += len(raw)
            self.in_string = bool((upto[-1] + self.in_string) % 2)
            self.depth = int(depths[-1])
            if depths.min() < 0:
                raise ValueError(f"malformed JSON in {self.file.source}: too many brackets close")
        return data, raw, free, depths


def _member_stage(block_bytes: int):
    """Members at depth 2 that begin in a block, read on to their end, wherever that is, and
    everything above depth 2 as one piece of ``outline`` per block."""

    def rows(incoming: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in incoming:
            for row in batch.to_pylist():
                yield from members(row["path"], row["block"], row["in_string"], row["depth"])

    def members(path: str, block: int, in_string: bool, depth: int) -> Iterator[dict]:
        file, start = _File(path), block * block_bytes
        scan = _Scan(file, start, in_string, depth)
        data, raw, free, depths = scan.next(block_bytes)
        steps = np.where(free, _steps(raw), 0)
        opens = (depths == 2) & (steps > 0)
        ends = (free & (depths == 2) & (raw == 0x2C)) | ((depths == 1) & (steps < 0))
        begins = np.flatnonzero(opens | (ends & (depths == 2)))
        stops = np.flatnonzero(ends)
        base = {"path": path, "block": block, "name": None}
        outline = (depths < 2) | opens
        # characters may be cut by a block's end; only the structure of this text matters
        yield base | {"kind": "outline", "text": raw[outline].tobytes().decode("latin-1")}
        name = None
        for begin in begins.tolist():
            if opens[begin]:
                name = _name_before(file, start + begin, raw[begin])
            after = int(np.searchsorted(stops, begin, "right"))
            if after < len(stops):
                text, end = data[begin + 1:stops[after]], raw[stops[after]]
            else:
                more, end = rest_of(scan)
                text = data[begin + 1:] + more
            first, last = bool(opens[begin]), end != 0x2C
            if text.strip():
                yield base | {"kind": "member", "name": name, "text": text.decode()}
            elif not (first and last):  # only an object without members has nothing
                raise ValueError(f"malformed JSON: nothing beside a comma in {path}")
        if name is not None:
            yield base | {"kind": "open", "name": name, "text": None}

    def rest_of(scan: _Scan) -> tuple[bytes, int]:
        parts = []
        while True:
            data, raw, free, depths = scan.next(1 << 20)
            if not data:
                raise ValueError("malformed JSON: it ends inside an object")
            steps = np.where(free, _steps(raw), 0)
            ends = np.flatnonzero(
                (free & (depths == 2) & (raw == 0x2C)) | ((depths == 1) & (steps < 0)))
            if len(ends):
                return b"".join([*parts, data[:ends[0]]]), int(raw[ends[0]])
            parts.append(data)

    def stage(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(incoming), _MEMBER_SCHEMA, lambda row: len(row["text"] or ""))

    return stage


def _name_before(file: _File, place: int, opened: int) -> str:
    """The name of the object that opens at a place; empty for an array."""
    if opened != 0x7B:
        return ""
    back = 1 << 10
    while True:
        found = _NAME.search(file.read(max(place - back, 0), min(back, place)))
        if found or back >= place:
            return json.loads(found[1]) if found else ""
        back *= 4


def members(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(path, name, text)`` of every member ``"key": value`` of the objects inside the one
    object in each of ``files(path, length)``, with the ``name`` of the object it is in; and
    ``(path, text)``, the outline of each file without those members.

    Files are read in blocks, by many tasks. A first pass sums up what each block does to the
    nesting, for both states it may start in; running totals over a file's blocks, which are
    a row each, give every block its state; the second pass cuts the members out. A member
    that crosses blocks is read by the task that holds its first byte. Brackets that do not
    match, or a file that ends early, fail the job.
    """
    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0)).cast("long")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    spread = blocks.repartition(
        max(1, blocks.sparkSession.sparkContext.defaultParallelism), "path", "block")
    sums = cut_lineage(spread.mapInArrow(_sum_stage(block_bytes), _SUMS), "json-sums")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    in_string = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    state = sums.withColumn("in_string", in_string)
    deeper = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    state = state.withColumn("deeper", deeper).withColumn(
        "depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)).cast("long"))
    state = cut_lineage(state, "json-blocks")
    broken = state.groupBy("path").agg(
        (F.sum("quotes") % 2).alias("quotes"), F.sum("deeper").alias("depth")).where(
        "quotes <> 0 or depth <> 0").first()
    if broken is not None:
        raise ValueError(f"malformed JSON: {broken['path']} ends inside a string or an object")
    cut = state.select("path", "block", "in_string", "depth").repartition(
        max(1, blocks.sparkSession.sparkContext.defaultParallelism), "path", "block")
    rows = cut_lineage(cut.mapInArrow(_member_stage(block_bytes), _MEMBERS), "json-members")
    # a block that begins inside an object has its name from the last block that opened one
    opened = rows.where("kind = 'open'").select("path", "block", F.col("name").alias("last"))
    carried = sums.select("path", "block").join(opened, ["path", "block"], "left").select(
        "path", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # filters may be evaluated in any order, so what parses the text must not see other rows
    text = F.when(F.col("kind") == "member", F.col("text")).alias("text")
    found = rows.where("kind = 'member'").join(carried, ["path", "block"]).select(
        "path", F.coalesce("name", "carried").alias("name"), text)
    outline = rows.where("kind = 'outline'").groupBy("path").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "")
        .alias("text"))
    return found, outline


def member_of(text: Column, schema: T.MapType) -> Column:
    """A member as a map of one entry; malformed ones fail the job."""
    return F.from_json(F.concat(F.lit("{"), text, F.lit("}")), schema, {"mode": "FAILFAST"})
