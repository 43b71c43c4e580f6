"""Building blocks that keep one hot key from ending up in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import shared_folder

# At most this many keys are treated as hot, the largest ones; that bounds what reaches the
# driver. Any other key has less than 1 / HOT_KEYS of the rows.
HOT_KEYS = 1000
HOT_ROWS = 1_000_000
HOT_PARTS = 256
LEFT_JOINS = ("inner", "left", "left_outer", "left_semi", "semi", "left_anti", "anti")
MAX_BUCKETS = 1024


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it survives lost executors."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lookup_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str,
    spread_by: str, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi join where few keys may hold a large share of ``left``.

    The hot keys are counted first (partial counts before the shuffle). Their left rows
    are spread over ``HOT_PARTS`` sub-keys by a hash of ``spread_by``, and only their
    right rows are repeated once per sub-key; all other rows join as usual. Joins that keep
    right rows without a match would repeat those, so they are refused.
    """
    if how not in LEFT_JOINS:
        raise ValueError(f"no spread join of kind {how!r}; one of {', '.join(LEFT_JOINS)}")
    hot = hot_keys(left, keys, hot_rows)
    if not hot:
        return left.join(right, list(keys), how)
    part = F.pmod(F.xxhash64(spread_by), F.lit(HOT_PARTS)).cast("int")
    is_hot = is_one_of(left, keys, hot)
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    salted_left = left.withColumn("_part", F.when(is_hot, part).otherwise(F.lit(0)))
    salted_right = right.withColumn("_part", F.explode(parts))
    return salted_left.join(salted_right, [*keys, "_part"], how).drop("_part")


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list[tuple]:
    """The ``HOT_KEYS`` largest keys, as far as they have more than ``hot_rows`` rows.

    Rows are counted in part before the shuffle, and only the largest counts are collected.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest = counts.where(F.col("_rows") > hot_rows).orderBy(F.desc("_rows")).limit(HOT_KEYS)
    return [tuple(row[k] for k in keys) for row in largest.collect()]


def is_one_of(df: DataFrame, keys: Sequence[str], values: list[tuple]) -> Column:
    """Whether the keys of a row of ``df`` are in a short list; nulls are equal."""
    types = [df.schema[k].dataType for k in keys]

    def entry(value: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, value, types)])

    return F.struct(*keys).isin(*map(entry, values))


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """``sum(value)`` over the rows of the same ``keys`` up to and including this row.

    ``order`` is numeric. A plain window puts a whole key into one task, which is right for
    all keys but the few hot ones. For those the order is cut into buckets at its quantiles:
    sums within a bucket come from a window over (key, bucket), and the sums of the earlier
    buckets from a table of at most ``MAX_BUCKETS`` rows per hot key.
    """
    hot = hot_keys(df, keys, rows_per_bucket)
    if not hot:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.sum(value).over(window))

    is_hot = is_one_of(df, keys, hot)
    cuts = quantile_cuts(df.where(is_hot), order, rows_per_bucket)
    bucketizer = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="_order", outputCol="_cut",
        handleInvalid="keep")
    # as one struct, keys with nulls are equal in a plain join, which can then use the
    # partitioning and the order of the window: the rows are shuffled and sorted once
    keyed = df.withColumns({
        "_key": F.struct(*keys), "_order": F.col(order).cast("double"), "_value": value})
    bucket = F.when(is_hot, F.col("_cut").cast("int"))
    bucketed = bucketizer.transform(keyed).withColumn(
        "_bucket", F.coalesce(bucket, F.lit(-1))).drop("_order", "_cut")

    within = Window.partitionBy("_key", "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = bucketed.where(is_hot).groupBy("_key", "_bucket").agg(F.sum("_value").alias("_sum"))
    offsets = sums.select("_key", "_bucket", F.sum("_sum").over(earlier).alias("_before"))
    local = bucketed.withColumn("_local", F.sum("_value").over(within))
    total = (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(out)
    return local.join(offsets, ["_key", "_bucket"], "left").select(*df.columns, total)


def numbered_rows(df: DataFrame, order: str, out: str = "place") -> DataFrame:
    """A number that grows along ``order``: rows are sorted in ranges, so no task sees all."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order)
    return ranged.withColumn(out, F.monotonically_increasing_id())


def number_within(
    df: DataFrame, keys: Sequence[str], order: str, out: str, rows_per_bucket: int = 1_000_000
) -> DataFrame:
    """1, 2, 3… within ``keys`` by ``order``, which must be unique within the keys."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, rows_per_bucket)


def quantile_cuts(df: DataFrame, order: str, rows_per_bucket: int) -> list[float]:
    """At most ``MAX_BUCKETS`` numbers that part the rows into buckets of that size."""
    shares = [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.percentile_approx(order, shares, F.lit(20 * MAX_BUCKETS)).alias("cuts"),
    ).first()
    wanted = max(2, min(MAX_BUCKETS, -(-row["rows"] // rows_per_bucket)))
    step = MAX_BUCKETS // wanted
    return sorted({float(cut) for cut in row["cuts"][step - 1::step]})
