"""SimHash fingerprints, and all fingerprints within a Hamming radius by permuted blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import groups_of, rows_of
from quire.llm.common import text_of, width
from quire.llm.hashing import shingle_hashes, word_hashes
from quire.operators.skew import cut_lineage

WORDS = 5
BITS = 64
RADIUS = 3
BLOCKS = 6
BATCH_BYTES = 2 << 20


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    """One 64-bit fingerprint per text: each term, a run of five words, votes on every bit
    with the bits of its hash, as often as it occurs; a bit is set where ones are more."""
    hashes, counts = word_hashes([text.encode() for text in texts])
    terms, number = shingle_hashes(hashes, counts, words)
    votes = np.zeros((len(texts), BITS), np.int64)
    some = np.flatnonzero(number)
    if len(some):
        ends = np.cumsum(number)
        bits = np.unpackbits(terms.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        starts = (ends - number)[some]
        at = 0
        while at < len(some):  # at most a few MB of votes at a time
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + 65_536)))
            rows = slice(starts[at], ends[some[to - 1]])
            votes[some[at:to]] = np.add.reduceat(
                bits[rows], starts[at:to] - starts[at], axis=0, dtype=np.int32)
            at = to
    ones = votes * 2 > number[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b) / BITS


def edited_text(text: str, following: str) -> str:
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _chain_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rows in order, where each needs the row after it. The last row of a
    block is a copy of the first row of the next one and gives no result of its own."""
    held: list[tuple] = []

    def results(rows: list[tuple]) -> pa.RecordBatch:
        texts = [row[3] for row in rows]
        whole = fingerprints(texts)
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0]]
        edits = [edited_text(texts[i], texts[i + 1]) for i in pairs]
        edited = fingerprints(edits)
        own = whole[pairs]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[i][2] for i in pairs], pa.int64()),
            "n_chars": pa.array([len(texts[i]) for i in pairs], pa.int64()),
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edits],
            "fingerprint": pa.array(own.view(np.int64), pa.int64()),
            "edited_fingerprint": pa.array(edited.view(np.int64), pa.int64()),
            "near_edited": _likeness(own, edited),
            "near_next": _likeness(own, whole[[i + 1 for i in pairs]]),
        })

    for group in groups_of(rows_of(batches), lambda row: len(row[3]), BATCH_BYTES):
        held += group
        yield results(held)
        held = held[-1:]


_CHAIN = ("doc_id long, n_chars long, edited_sha256 string, fingerprint long, "
          "edited_fingerprint long, near_edited double, near_next double")


def chain(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs(doc_id, text)`` and of its edited text.

    Rows are dealt to blocks by quantiles of doc_id. The first row of each block goes to the
    block before it as well, so all rows meet the row after them with one shuffle of the
    texts and no task that holds more than a block, read as a stream.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    parts = width(spark)
    row = texts.agg(F.percentile_approx(
        "doc_id", [i / parts for i in range(1, parts)], F.lit(100 * parts))).first()
    cuts = sorted(set(row[0] or []))
    block = F.lit(0)
    if cuts:
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col("doc_id")))
        block = F.when(F.col("doc_id").isNull(), 0).otherwise(place)
    dealt = texts.select(block.alias("block"), F.lit(0).alias("copy"), "doc_id", "text")
    heads = cut_lineage(dealt.groupBy("block").agg(
        F.min(F.struct("doc_id", "text")).alias("head")), "simhash-heads")
    filled = sorted(r[0] for r in heads.select("block").collect())  # one per block
    before = spark.createDataFrame(
        [(b, filled[i - 1]) for i, b in enumerate(filled)], "block int, before int")
    copies = heads.join(F.broadcast(before), "block").select(
        F.col("before").alias("block"), F.lit(1).alias("copy"), "head.doc_id", "head.text")
    ordered = dealt.unionByName(copies).repartition(parts, "block").sortWithinPartitions(
        "block", "copy", "doc_id", "text")
    return ordered.mapInArrow(_chain_stage, _CHAIN)


def _tables(radius: int, blocks: int) -> list[int]:
    """Masks: every choice of ``blocks - radius`` of the blocks. Two fingerprints within the
    radius differ in at most ``radius`` blocks, so they are equal under one of the masks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(some) for some in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def within(
    queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """``query, fingerprint, distance``: for every fingerprint of ``queries(fingerprint)``,
    all distinct ones of ``prints(fingerprint)`` within ``radius`` bits, itself included.

    With six blocks and radius three there are twenty tables, each keyed by about 32 bits.
    A pair is reported in the first table where it is equal, so no pair comes twice. Equal
    fingerprints are one row, so copies do not fill a key.
    """
    masks = [_signed(mask) for mask in _tables(radius, blocks)]
    entries = F.explode(F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks)]))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("fingerprint").distinct().select("fingerprint", entries.alias("e"))
        return rows.select(F.col("fingerprint").alias(name), "e.table", "e.key")

    pairs = keyed(queries, "query").join(keyed(prints, "fingerprint"), ["table", "key"])
    differing = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first: Column = F.coalesce(*[
        F.when(differing.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    distance = F.bit_count(differing)
    return pairs.where((distance <= radius) & (F.col("table") == first)).select(
        "query", "fingerprint", distance.alias("distance"))


def simhash_digest(docs: DataFrame, every: int = 50) -> DataFrame:
    """Fingerprints of documents and edited texts; for the stated queries, rows whose doc_id
    is divisible by ``every``, also how many documents lie within the radius (n_within).

    Null and empty texts have no terms and the fingerprint 0. Rows with equal doc_ids follow
    each other by text; null doc_ids come first. After the last row comes the first, which
    is itself where there is only one. Other columns are ignored; no rows give none.
    """
    rows = cut_lineage(chain(docs), "simhash")
    prints = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("documents"))
    asked = F.col("doc_id") % every == 0
    pairs = within(rows.where(asked), prints)
    counts = pairs.join(prints, "fingerprint").groupBy("query").agg(
        F.sum("documents").alias("n_within"))
    answered = rows.where(asked).withColumn("query", F.col("fingerprint")).join(
        counts, "query", "left").drop("query")
    others = rows.where(~F.coalesce(asked, F.lit(False))).withColumn(
        "n_within", F.lit(None).cast("long"))
    joined = answered.unionByName(others)
    name = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias(c)
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", name("fingerprint"), name("edited_fingerprint"),
        "near_edited", "near_next", "n_within")
