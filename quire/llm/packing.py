"""Length buckets that minimise padding, and token-budget batches inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, text_of, words_of
from quire.operators.skew import cut_lineage

BUCKETS = 16
BUDGET = 16_384
MAX_LENGTH = 16_384


def best_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the padded total.

    ``histogram`` has (length, rows). The cost of lengths i+1..j in one bucket is
    length[j] times their rows, so for every number of buckets the best cut is the lowest
    of lines with falling slopes at growing places: one pass over a hull of lines. Of equal
    cuts the earliest is taken, and of equal totals the fewest buckets.
    """
    rows = sorted(histogram)
    lengths = [length for length, _ in rows]
    below = [0]
    for _, n in rows:
        below.append(below[-1] + n)
    m = len(lengths)
    if not m:
        return []
    best = [None] + [lengths[j] * below[j + 1] for j in range(m)]
    cuts = [[0] * (m + 1)]
    totals = [best[m]]
    for used in range(2, min(buckets, m) + 1):
        following, cut = [None] * (m + 1), [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, height, i), slope = -below[i]
        at = 0
        for j in range(used, m + 1):
            i = j - 1
            slope, height = -below[i], best[i]
            while len(hull) - at >= 2 and _useless(hull[-2], hull[-1], (slope, height)):
                hull.pop()
            hull.append((slope, height, i))
            x = lengths[j - 1]
            while at + 1 < len(hull) and _value(hull[at + 1], x) < _value(hull[at], x):
                at += 1
            following[j] = _value(hull[at], x) + x * below[j]
            cut[j] = hull[at][2]
        best, cuts, totals = following, cuts + [cut], totals + [following[m]]
    used = totals.index(min(totals))
    bounds, j = [], m
    while used >= 0:
        bounds.append(lengths[j - 1])
        j = cuts[used][j]
        used -= 1
    return bounds[::-1]


def _value(line: tuple, x: int) -> int:
    return line[0] * x + line[1]


def _useless(left: tuple, middle: tuple, right: tuple) -> bool:
    """Whether the middle line is nowhere below both others."""
    return (right[1] - left[1]) * (left[0] - middle[0]) < (middle[1] - left[1]) * (
        left[0] - right[0])


def pack(
    docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS,
    budget: int = BUDGET, max_length: int = MAX_LENGTH,
) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_length, batch, slot, padding`` for every row of
    ``docs(doc_id, text)``; other columns are ignored.

    ``length`` is the number of tokens of a row, by default its words; null counts as 0.
    The histogram of all lengths up to ``max_length`` (so at most that many numbers reach
    the driver) decides the bounds of the buckets. Inside a bucket, rows by doc_id fill
    batches of as many rows as the budget holds at the padded length, at least one. A row
    longer than ``max_length`` is a batch of its own in the last bucket, without padding:
    nothing is cut or left out. Repeated rows take a slot each.
    """
    spark = docs.sparkSession
    size = F.size(words_of(text_of())) if length is None else F.coalesce(length, F.lit(0))
    rows = cut_lineage(docs.select("doc_id", size.cast("long").alias("n_tokens")), "pack-rows")
    counted = rows.where(F.col("n_tokens") <= max_length).groupBy("n_tokens").count()
    bounds = best_bounds([(row[0], row[1]) for row in counted.collect()], buckets)
    table = [(k, low, high) for k, (low, high) in enumerate(zip([-1, *bounds], bounds))]
    found = spark.createDataFrame(
        [(k, bound, max(1, budget // max(bound, 1))) for k, _, bound in table],
        "bucket int, bucket_length long, capacity long")
    bucket = F.coalesce(
        *[F.when(F.col("n_tokens") <= high, F.lit(k)) for k, _, high in table],
        F.lit(len(table)))
    dealt = rows.withColumn("bucket", bucket.cast("int"))
    places = numbered(dealt, "bucket", ["doc_id", "n_tokens"], "place", "pack-places")
    filled = places.join(F.broadcast(found), "bucket", "left")  # one row per bucket
    capacity = F.coalesce("capacity", F.lit(1))
    bound = F.coalesce("bucket_length", "n_tokens")
    return filled.select(
        "doc_id", "n_tokens", "bucket", bound.alias("bucket_length"),
        F.floor(F.col("place") / capacity).alias("batch"),
        (F.col("place") % capacity).cast("int").alias("slot"),
        (bound - F.col("n_tokens")).alias("padding"))
