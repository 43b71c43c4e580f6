"""Token counts of documents in flat token files without an index."""

from __future__ import annotations

import json
import string
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.arrow import groups_of, rows_of
from quire.llm.bpe import load_tokenizer, split_words, tokenizer_json
from quire.llm.common import text_of
from quire.operators.skew import cut_lineage
from quire.session import shared_folder

END_OF_TEXT = 49_407
BLOCK_BYTES = 4 << 20
KNOWN_WORDS = 200_000
SUPER = 1024
# Characters that are letters in every normal form, so that what follows is a token apart.
_LETTERS = frozenset(string.ascii_letters) | {
    chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _open(path: str):
    """The store and the place in it of a path as Spark writes it."""
    from pyarrow import fs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def tokens_of(tokenizer, words: list[str]) -> Iterator[tuple[str, bytes]]:
    """Words with their tokens as the files hold them; offsets, which nobody reads, are not
    worked out."""
    for at in range(0, len(words), 4096):
        some = words[at:at + 4096]
        for word, found in zip(
                some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
            ids = found.ids
            yield word, struct.pack(f"<{len(ids)}H", *ids)


def cuts_endings(definition: str) -> bool:
    """Whether the tokenizer cuts words between letters and other signs, and after lowering
    their case; of other tokenizers nothing is assumed."""
    parts = json.loads(definition)
    normal = [part["type"] for part in (parts.get("normalizer") or {}).get("normalizers", [])]
    pre = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == [
        "Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": _PIECES}
        and pre[0]["invert"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"])


def stems_of(words: set[str]) -> dict[str, tuple[str, str]]:
    """Words without ASCII punctuation at the end, which the tokenizer encodes apart when a
    letter stands before it, and that punctuation. Plain words are in lower case."""
    cut = {}
    for word in words:
        stem, ending = word.rstrip(string.punctuation), ""
        if len(stem) < len(word):
            if stem and stem[-1] in _LETTERS:
                ending = word[len(stem):]
            else:
                stem = word
        cut[word] = (stem.lower() if stem.isascii() else stem, ending)
    return cut


class WordStore:
    """The tokens of words seen, in two generations: when the younger is full, the older one
    goes, and what is met in it before returns to the younger. So words that come again and
    again are encoded once, and no more than twice ``KNOWN_WORDS`` are held, and a group's."""

    def __init__(self, tokenizer, apart: bool):
        self.tokenizer, self.apart = tokenizer, apart
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def tokens(self, words: set[str]) -> dict[str, bytes]:
        if not self.apart:
            self._meet(words)
            return self.recent
        cut = stems_of(words)
        self._meet({piece for pair in cut.values() for piece in pair if piece})
        known = self.recent
        return {word: known[stem] + known[ending] if ending else known[stem]
                for word, (stem, ending) in cut.items()}

    def _meet(self, pieces: set[str]) -> None:
        if len(self.recent) > KNOWN_WORDS:
            self.recent, self.older = {}, self.recent
        new = [piece for piece in pieces if piece not in self.recent]
        self.recent.update((p, self.older[p]) for p in new if p in self.older)
        self.recent.update(tokens_of(self.tokenizer, [p for p in new if p not in self.older]))


def write_token_files(
    docs: DataFrame, folder: str | None = None, path: str | None = None,
    end: int = END_OF_TEXT,
) -> DataFrame:
    """Writes ``docs(doc_id, text)`` to flat files of little-endian unsigned 16-bit tokens,
    each document followed by ``end``, and returns ``file, bytes, ordinal, doc_id``.

    A task writes one file under a name of its own; what an attempt that failed has left is
    not in the table returned. The strings of special tokens in a text are ordinary text.
    """
    spark = docs.sparkSession
    target = folder or shared_folder(spark, "token-files")
    definition = spark.sparkContext.broadcast(tokenizer_json(path))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = load_tokenizer(definition.value)
        tokenizer.encode_special_tokens = True
        store, place = _open(target)
        store.create_dir(place, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        mark = np.array([end], "<u2").tobytes()
        seen = WordStore(tokenizer, cuts_endings(definition.value))
        ids, size = [], 0
        with store.open_output_stream(f"{place}/{name}") as out:
            for group in groups_of(rows_of(batches), lambda row: len(row[1]), 4 << 20):
                split = [split_words(text) for _, text in group]
                known = seen.tokens({w for words in split for w in words})
                for (doc_id, _), words in zip(group, split):
                    data = b"".join([known[w] for w in words]) + mark
                    out.write(data)
                    size += len(data)
                    ids.append(doc_id)
        file = f"{target}/{name}"
        for at in range(0, len(ids), 8192):
            n = len(ids[at:at + 8192])
            yield pa.RecordBatch.from_pydict({
                "file": [file] * n, "bytes": pa.array([size] * n, pa.int64()),
                "ordinal": pa.array(range(at, at + n), pa.int64()),
                "doc_id": pa.array(ids[at:at + n], pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    written = texts.mapInArrow(stage, "file string, bytes long, ordinal long, doc_id long")
    return cut_lineage(written, "token-file-list")


def scan_separators(
    files: DataFrame, end: int = END_OF_TEXT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``file, ordinal, start, n_tokens, closed``: the documents of flat token files, found
    by their end marks alone. ``files(file, bytes)`` has one row per file.

    Files are cut into blocks without regard to documents; each block is searched with one
    vectorised comparison. A running count of the marks and a running maximum of their
    places over the blocks of a file then give every block what it needs from those before
    it. The scan has two levels, so a file of any length is no single task: blocks within
    runs of 1,024, then the runs. Tokens after the last mark are a document that is not
    closed; an empty file has no documents.
    """
    step = block_bytes // 2 * 2
    offsets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step)))
    ranges = files.where("bytes > 1").select(
        "file", "bytes", offsets.alias("offset")).repartition("file", "offset")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, size, offset in rows_of(batches):
            store, place = _open(file)
            with store.open_input_file(place) as source:
                data = source.read_at(min(step, size - offset) // 2 * 2, offset)
            marks = np.flatnonzero(np.frombuffer(data, "<u2") == end) + offset // 2
            yield pa.RecordBatch.from_pydict({
                "file": [file], "block": pa.array([offset // step], pa.int64()),
                "tokens": pa.array([size // 2], pa.int64()),
                "marks": pa.array([marks.tolist()], pa.list_(pa.int64()))})

    found = cut_lineage(ranges.mapInArrow(
        search, "file string, block long, tokens long, marks array<long>"), "token-marks")
    nothing, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    narrow = found.select(
        "file", "block", F.floor(F.col("block") / SUPER).alias("run"),
        F.size("marks").cast("long").alias("n"),
        F.coalesce(F.try_element_at("marks", F.lit(-1)), none).alias("last"))
    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = narrow.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = runs.select(
        "file", "run", F.coalesce(F.sum("n").over(outer), nothing).alias("run_n"),
        F.coalesce(F.max("last").over(outer), none).alias("run_last"))
    carried = narrow.select(
        "file", "run", "block", F.coalesce(F.sum("n").over(inner), nothing).alias("n"),
        F.coalesce(F.max("last").over(inner), none).alias("last")).join(before, ["file", "run"])
    carry = carried.select(
        "file", "block", (F.col("n") + F.col("run_n")).alias("before"),
        F.greatest("last", "run_last").alias("previous"))
    blocks = found.join(carry, ["file", "block"])
    each = blocks.select("file", "before", "previous", "marks", F.posexplode("marks"))
    start = F.coalesce(F.get("marks", F.col("pos") - 1), F.col("previous")) + 1
    closed = each.select(
        "file", (F.col("before") + F.col("pos")).alias("ordinal"), start.alias("start"),
        (F.col("col") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = narrow.groupBy("file").agg(F.sum("n").alias("ordinal"), F.max("last").alias("last"))
    sizes = found.groupBy("file").agg(F.max("tokens").alias("tokens"))
    rest = ends.join(sizes, "file").where("last + 1 < tokens").select(
        "file", "ordinal", (F.col("last") + 1).alias("start"),
        (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def token_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, start, closed``: documents written to flat files and found again.

    The scan knows nothing of the documents; their ids are joined by file and order. Null
    and empty texts have no tokens; repeated rows are documents of their own.
    """
    listed = write_token_files(docs)
    files = listed.select("file", "bytes").distinct()
    found = scan_separators(files)
    return found.join(listed.select("file", "ordinal", "doc_id"), ["file", "ordinal"]).select(
        "doc_id", "n_tokens", "start", "closed")
