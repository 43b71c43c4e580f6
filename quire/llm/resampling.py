"""Importance resampling: documents drawn so that their n-grams look like a target's."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.arrow import bounded
from quire.llm.common import numbered
from quire.operators.skew import cut_lineage

# Everything that is not a word: ASCII but for digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
SLICE = 4 << 20


def hashed_grams(
    texts: pa.Array, shortest: int, longest: int, buckets: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every size of n-gram: the text that each n-gram is in (ascending), and its bucket,
    the CRC-32 of the joined words modulo ``buckets``. First comes the pair for words alone,
    whatever ``shortest`` is, with buckets only if 1 is among the sizes.

    An n-gram is a pair of an (n-1)-gram and a word, both numbers of a dictionary; the
    checksum of a distinct pair continues that of its first part.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    coded = pc.dictionary_encode(words.filter(full))
    rows = rows.filter(full).to_numpy()
    word = coded.indices.to_numpy().astype(np.int64)
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    sums = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    gram = word
    yield rows, (sums % buckets)[gram] if shortest <= 1 else None
    for size in range(2, longest + 1):
        n = max(len(rows) - size + 1, 0)
        inside = np.flatnonzero(rows[:n] == rows[size - 1:])
        pairs = gram[:n] * max(len(names), 1) + word[size - 1:]
        coded = pc.dictionary_encode(pa.array(pairs))
        first, last = np.divmod(coded.dictionary.to_numpy(), max(len(names), 1))
        sums = np.fromiter(
            (zlib.crc32(b" " + names[j], i) for i, j in zip(sums[first].tolist(), last.tolist())),
            np.uint32, len(first))
        gram = coded.indices.to_numpy().astype(np.int64)
        if size >= shortest:
            yield rows[inside], (sums % buckets)[gram[inside]]


def bucket_counts(
    docs: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS
) -> DataFrame:
    """``bucket, n``: the n-grams of all texts by bucket; tasks add theirs up first, so a task
    sends at most one row per bucket."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in bounded(batches, "text", SLICE):
            for _, found in hashed_grams(batch.column("text"), shortest, longest, buckets):
                if found is not None:
                    counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(stage, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target, rounded down; every
    bucket has one n-gram more than counted, so there is no zero."""
    all_source, all_target = sum(source.values()), sum(target.values())
    return np.array([
        math.floor(1000 * math.log(
            float(target.get(b, 0) + 1) * float(all_source + buckets)
            / (float(source.get(b, 0) + 1) * float(all_target + buckets))))
        for b in range(buckets)], np.int64)


def weighed(
    docs: DataFrame, gains: np.ndarray, shortest: int = 1, longest: int = 1,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The ``keep`` columns, and as ``_n_words, _n_features, _weight`` the number of words, of
    n-grams, and the sum of the gains of those."""
    fields = [docs.schema[name] for name in keep]
    added = ["_n_words", "_n_features", "_weight"]
    schema = T.StructType([*fields, *[T.StructField(name, T.LongType()) for name in added]])
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_text", SLICE):
            found = hashed_grams(batch.column("_text"), shortest, longest, len(gains))
            n_words, numbers, weights = None, 0, 0
            for owner, buckets in found:
                ends = np.searchsorted(owner, np.arange(batch.num_rows), "right")
                sizes = np.diff(ends, prepend=0)
                n_words = sizes if n_words is None else n_words
                if buckets is not None:
                    upto = np.concatenate([[0], np.cumsum(gains[buckets])])[ends]
                    numbers, weights = numbers + sizes, weights + np.diff(upto, prepend=0)
            more = [pa.array(np.asarray(x, np.int64)) for x in (n_words, numbers, weights)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*keep, *added])

    return rows.mapInArrow(stage, schema)


def noise(doc_id: Column, seed: str) -> Column:
    """1000 times a draw from the Gumbel distribution, rounded down, that only depends on the
    document and the seed."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def resample(
    docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
    seed: str = SEED, keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``docs(doc_id, text)`` with ``n_words, n_features, weight, score, rank``, and of their
    own columns those in ``keep``, which must hold ``doc_id`` and may hold the text.

    Features are all runs of ``shortest`` to ``longest`` words, repeats counted. A document
    weighs as much as its features are likelier in ``target(text)`` than in all of ``docs``.
    Of the documents with ``least_words`` words or more, the ``percent`` of a hundred with the
    highest scores (weight plus noise) are drawn and ranked 1, 2, 3…; others have no rank.
    Ties go to the smaller doc_id, a missing one first.

    Null texts are empty: no features, weight 0. A missing doc_id has the noise of an empty
    name. Repeated rows count and are ranked each. Without documents the result is empty;
    without target all buckets are equally likely in it. Texts are read twice, in slices of
    a few megabytes (a longer text is a slice of its own); what the driver gets are the
    counts of the buckets, so their number is the bound.
    """
    counts = [
        {row["bucket"]: row["n"] for row in
         bucket_counts(some, shortest, longest, buckets).collect()} for some in (docs, target)]
    gains = bucket_gains(*counts, buckets)
    found = weighed(docs, gains, shortest, longest, keep)
    score = F.col("_weight") + noise(F.col("doc_id"), seed)
    # highest scores first, in an order that only goes up
    scored = cut_lineage(found.withColumn("_low", -score), "resample-scored")
    enough = F.col("_n_words") >= least_words
    able = scored.where(enough)
    drawn = percent * able.count() // 100
    ranked = numbered(
        able.withColumn("_all", F.lit(0)), "_all", ["_low", "doc_id", "_n_features"],
        "_place", "resample-places").drop("_all")
    every = ranked.unionByName(
        scored.where(~enough).withColumn("_place", F.lit(None).cast("long")))
    place = F.col("_place") + 1
    return every.select(
        *keep, F.col("_n_words").alias("n_words"), F.col("_n_features").alias("n_features"),
        F.col("_weight").alias("weight"), (-F.col("_low")).alias("score"),
        F.when(place <= drawn, place).alias("rank"))


def resample_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
