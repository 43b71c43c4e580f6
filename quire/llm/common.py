"""Helpers that several operators share: words, written tables, numbering, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.skew import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, where null means empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def placed(df: DataFrame, key: str, order: Sequence[str], label: str) -> DataFrame:
    """``df`` sorted by (key, order) over ranges of about equal size, and written.

    ``_part`` and ``_at`` (a number that grows within a part) give each row its place, so
    numbers and sums along the order need no task that holds a whole key.
    """
    ranged = df.repartitionByRange(width(df.sparkSession), key, *order)
    at = ranged.sortWithinPartitions(key, *order).withColumn(
        "_at", F.monotonically_increasing_id())
    return cut_lineage(at.withColumn("_part", F.shiftright("_at", 33)), label)


def numbered(df: DataFrame, key: str, order: Sequence[str], out: str, label: str) -> DataFrame:
    """Adds 0, 1, 2… within ``key`` by ``order``. A hot key is spread over many tasks."""
    rows = placed(df, key, order, label)
    blocks = rows.groupBy(key, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = blocks.select(
        F.col(key).alias("_key"), F.col("_part").alias("_block"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = rows.join(
        offsets, rows[key].eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_block")))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return joined.select(*df.columns, place.alias(out))


def components(edges: DataFrame, label: str) -> DataFrame:
    """``(id, component)`` for the nodes of ``edges(a, b)``: the smallest id reachable.

    Every round lets each node's neighbours point at the smallest node of the neighbourhood
    (large star, then small star), which keeps the number of edges and takes a number of
    rounds that grows with the logarithm of a chain. A hot node's edges are reduced by
    partial aggregates, never gathered.
    """
    current = cut_lineage(
        edges.where("a <> b").select(
            F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), label)
    before = None
    while True:
        both = current.unionAll(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.min("lo").alias("m")).select(
            "hi", F.least("hi", "m").alias("m"))
        large = both.join(low, "hi").where("lo > hi").select(
            F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        # after the large star a node has one smaller neighbour per component it touches
        least = large.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
        after = least.select(
            F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
            F.col("m").alias("lo")).distinct()
        current = cut_lineage(after, label)
        state = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum")).first()
        if state == before:
            break
        before = state
    roots = current.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return roots.unionAll(
        roots.select(F.col("component").alias("id"), "component").distinct())


BROADCAST_ROWS = 1_000_000


def matched(left: DataFrame, right: DataFrame, on: Column, how: str, rows: int) -> DataFrame:
    """A join in which the rows of ``left`` are large, such as whole texts.

    ``rows`` is the counted number of rows of ``right``, which must be narrow: up to a
    million of them go to every task, so that no text moves; above that, both sides are
    shuffled.
    """
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)
