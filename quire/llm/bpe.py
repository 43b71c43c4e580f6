"""BPE encoding of distinct words, and decoding by pieces."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.arrow import groups_of, rows_of
from quire.llm.common import text_of, width

BLOCK_BYTES = 8 << 20
_CODED = -1  # the bucket of a row that holds a block's texts, not its words
_ROWS = "block string, bucket int, deal int, doc_ids binary, data binary"
_SCHEMA = pa.schema([
    ("block", pa.string()), ("bucket", pa.int32()), ("deal", pa.int32()),
    ("doc_ids", pa.binary()), ("data", pa.binary())])
# str.split() also cuts at these; the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's definition; it travels to the tasks as a value."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def load_tokenizer(definition: str):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def split_words(text: str) -> list[str]:
    """Pieces between white space. No token of the tokenizer spans white space, and its
    normal form of a text is that of the pieces, so pieces can be encoded one by one."""
    if _NOT_SPACE.search(text):
        return [word for word in _SPACE.split(text) if word]
    return text.split()


def _packed(values: np.ndarray) -> bytes:
    """Numbers compressed: how many bytes each takes, then byte by byte, those of numbers of
    one, two and four bytes apart, as each kind has a distribution of its own."""
    values = values.astype("<u4")
    kind = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF)
    planes = [kind.tobytes()]
    for size, k in ((1, 0), (2, 1), (4, 2)):
        some = values[kind == k].view(np.uint8).reshape(-1, 4)
        planes += [some[:, i].tobytes() for i in range(size)]
    parts = []
    for plane in planes:
        data = pa.compress(plane, "zstd", asbytes=True) if plane else b""
        parts += [len(plane).to_bytes(8, "little"), len(data).to_bytes(8, "little"), data]
    return b"".join(parts)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes, at = [], 0
    while at < len(data):
        size, packed = (int.from_bytes(data[at + i:at + i + 8], "little") for i in (0, 8))
        at += 16
        plane = pa.decompress(data[at:at + packed], size, "zstd", asbytes=True) if size else b""
        planes.append(np.frombuffer(plane, np.uint8))
        at += packed
    values, first = np.zeros(n, np.uint32), 1
    for size, k in ((1, 0), (2, 1), (4, 2)):
        some = np.zeros(len(planes[first]), np.uint32)
        for i in range(size):
            some |= planes[first + i].astype(np.uint32) << np.uint32(8 * i)
        values[planes[0] == k] = some
        first += size
    return values


def _framed(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths."""
    parts = [np.array([len(arrays)], "<u8").tobytes()]
    for values in arrays:
        data = _packed(values)
        parts += [np.array([len(values), len(data)], "<u8").tobytes(), data]
    return b"".join(parts)


def _unframed(data: bytes) -> list[np.ndarray]:
    count, at, found = int(np.frombuffer(data, "<u8", 1)[0]), 8, []
    for _ in range(count):
        n, size = map(int, np.frombuffer(data, "<u8", 2, at))
        found.append(_unpacked(data[at + 16:at + 16 + size], n))
        at += 16 + size
    return found


def _word_stage(buckets: int, block_bytes: int):
    """Texts to blocks: the words of each block once, by bucket, and the texts as codes.

    A block is named by its place and its content, so a task that is repeated after a loss
    names it alike, and one that met its rows in another order does not.
    """
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, group in enumerate(
                groups_of(rows_of(batches), lambda row: len(row[1]), block_bytes)):
            table: dict[str, int] = {}
            ids, lengths, codes = [], [], []
            for doc_id, text in group:
                words = split_words(text)
                ids.append(doc_id)
                lengths.append(len(words))
                codes.append(np.fromiter(
                    (table.setdefault(w, len(table)) for w in words), np.uint32, len(words)))
            whole = np.concatenate(codes)
            often = np.argsort(-np.bincount(whole, minlength=len(table)), kind="stable")
            rank = np.empty(len(table), np.uint32)
            rank[often] = np.arange(len(table))
            whole = rank[whole]  # frequent words have small numbers, which pack well
            known = [w.encode() for w in table]
            words = [known[i] for i in often.tolist()]
            table.clear()
            bucket_of = np.fromiter(
                (zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
            order = np.argsort(bucket_of, kind="stable")
            counts = np.bincount(bucket_of, minlength=buckets)
            doc_ids = json.dumps(ids).encode()
            codes = _framed(bucket_of, np.array(lengths, np.uint32), whole)
            digest = hashlib.blake2b(doc_ids, digest_size=16)
            digest.update(codes)
            at, packed = 0, {}
            for bucket in np.flatnonzero(counts).tolist():
                some = b"\n".join([words[i] for i in order[at:at + counts[bucket]].tolist()])
                at += int(counts[bucket])
                digest.update(some)
                packed[bucket] = (
                    len(some).to_bytes(8, "little") + pa.compress(some, "zstd", asbytes=True))
            block = f"{part}-{number}-{digest.hexdigest()}"
            yield pa.RecordBatch.from_pylist([{
                "block": block, "bucket": _CODED, "deal": zlib.crc32(block.encode()) % buckets,
                "doc_ids": doc_ids, "data": codes}], _SCHEMA)
            rows = [{"block": block, "bucket": bucket, "deal": bucket, "data": data}
                    for bucket, data in packed.items()]
            for start in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[start:start + 256], _SCHEMA)

    return stage


def _encode_stage(definition):
    """Words of a bucket to ids. The table of the bucket's words lives as long as the task,
    so each distinct word is encoded once. Texts as codes go through as they are."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = load_tokenizer(definition.value)
        known: dict[bytes, bytes] = {}
        for block, bucket, deal, doc_ids, data in _singly(batches):
            if bucket == _CODED:
                yield pa.RecordBatch.from_pylist([{
                    "block": block, "bucket": bucket, "deal": deal, "doc_ids": doc_ids,
                    "data": data}], _SCHEMA)
                continue
            size = int.from_bytes(data[:8], "little")
            words = pa.decompress(data[8:], size, "zstd", asbytes=True).split(b"\n")
            new = [w for w in words if w not in known]
            for at in range(0, len(new), 4096):
                some = new[at:at + 4096]
                encoded = tokenizer.encode_batch(
                    [w.decode() for w in some], add_special_tokens=False)
                for word, found in zip(some, encoded):
                    known[word] = np.array(found.ids, "<u4").tobytes()
            ids = [known[w] for w in words]
            counts = np.fromiter((len(x) // 4 for x in ids), np.uint32, len(ids))
            flat = np.frombuffer(b"".join(ids), "<u4")
            yield pa.RecordBatch.from_pylist([{
                "block": block, "bucket": bucket, "deal": deal,
                "data": _framed(counts, flat)}], _SCHEMA)

    return stage


def _singly(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one at a time, as each may hold megabytes."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(column[at].as_py() for column in batch.columns)


def _position_stage(block: pa.Table) -> pa.Table:
    """Joins the ids of a block's words back by position."""
    schema = pa.schema([("doc_ids", pa.int64()), ("ids", pa.binary())])
    names = block["bucket"].to_pylist()
    coded = [i for i, bucket in enumerate(names) if bucket == _CODED]
    replies = sorted((bucket, i) for i, bucket in enumerate(names) if bucket != _CODED)
    frames = [_unframed(block["data"][i].as_py()) for _, i in replies]
    done = []
    for i in coded:
        bucket_of, lengths, codes = _unframed(block["data"][i].as_py())
        if [bucket for bucket, _ in replies] != np.unique(bucket_of).tolist():
            raise ValueError("the words of a block are not those of its texts: the rows of the "
                             "input changed their order while it was read again")
        counts = np.zeros(len(bucket_of), np.int64)
        order = np.argsort(bucket_of, kind="stable")
        flat = np.concatenate([f[1] for f in frames]) if frames else np.zeros(0, np.uint32)
        sizes = np.concatenate([f[0] for f in frames]) if frames else np.zeros(0, np.uint32)
        counts[order] = sizes
        starts = np.zeros(len(bucket_of), np.int64)
        starts[order] = np.cumsum(sizes, dtype=np.int64) - sizes
        ids, out = json.loads(block["doc_ids"][i].as_py()), []
        ends = np.cumsum(lengths, dtype=np.int64)
        for end, length in zip(ends.tolist(), lengths.tolist()):
            own = codes[end - length:end]
            n = counts[own]
            places = np.repeat(starts[own] - (np.cumsum(n) - n), n)
            out.append(flat[places + np.arange(len(places))].astype("<u4").tobytes())
        done.append(pa.table([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], schema))
    if not done:
        raise ValueError("words of a block without its texts")
    return pa.concat_tables(done)


def encode(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs(doc_id, text)``; ids are little-endian
    unsigned 32-bit numbers, as the tokenizer encodes the whole text.

    Texts are cut into words and laid out in blocks of up to ``block_bytes`` (or one longer
    text): a block's distinct words, dealt to buckets by a hash, and its texts as numbers of
    words. All blocks' words of a bucket meet in one task, which encodes each distinct word
    once, and the ids go back to the blocks, where they are put in place. So what is
    shuffled are lists of distinct words and numbers, never texts or single occurrences,
    and no word is hot, as it comes once from a block. Nothing is written besides the two
    shuffles; where rows of the input come in another order when lost tasks are repeated,
    the job ends with an error, as words and texts would not belong together.

    Null and empty texts have no ids; repeated rows have the same ids each; other columns
    are ignored; a table without rows gives none.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_json(path))
    buckets = width(spark)
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    blocks = texts.mapInArrow(_word_stage(buckets, block_bytes), _ROWS)
    encoded = blocks.repartition(buckets, "deal").mapInArrow(_encode_stage(definition), _ROWS)
    joined = encoded.groupBy("block").applyInArrow(_position_stage, "doc_ids long, ids binary")
    return joined.select(F.col("doc_ids").alias("doc_id"), "ids")


def _pieces(spark: SparkSession, path: str | None):
    """The piece of every id, broadcast: as large as the vocabulary, whatever the data."""
    definition = tokenizer_json(path)
    if json.loads(definition).get("decoder"):
        raise ValueError("a tokenizer with a decoder does not join its pieces by one string")
    vocabulary = load_tokenizer(definition).get_vocab(with_added_tokens=True)
    pieces = [""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, number in vocabulary.items():
        pieces[number] = piece
    return spark.sparkContext.broadcast(pieces)


def decode(encoded: DataFrame, path: str | None = None, joiner: str = " ") -> DataFrame:
    """Adds ``decoded`` to ``encoded(doc_id, ids)``, special tokens included.

    Ids meet their pieces in a table that is as large as the vocabulary, whatever the data,
    so every task holds it. Pieces are joined by a space, as the library does for a
    tokenizer without a decoder; a definition with one is refused.
    """
    table = _pieces(encoded.sparkSession, path)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_of = table.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                texts = [
                    joiner.join(map(piece_of, np.frombuffer(ids, "<u4").tolist()))
                    for ids in some.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("ids"), pa.array(texts, pa.string())],
                    ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(
        stage, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame, path: str | None = None, joiner: str = " ") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encoded(doc_id, ids)``: what
    ``decode`` gives, of which only digests leave the task, one text at a time."""
    table = _pieces(encoded.sparkSession, path)
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digested(doc_id: int | None, ids: bytes) -> tuple:
        numbers = np.frombuffer(ids, "<u4")
        text = joiner.join(map(table.value.__getitem__, numbers.tolist()))
        return (doc_id, len(numbers), hashlib.sha256(ids).hexdigest(),
                hashlib.sha256(text.encode()).hexdigest())

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for group in groups_of(rows_of(batches), lambda row: len(row[1]), BLOCK_BYTES):
            columns = zip(*(digested(*row) for row in group))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, kinds)], names)

    return encoded.select("doc_id", "ids").mapInArrow(stage, kind)


def bpe_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    return digests(encode(docs, path), path)
