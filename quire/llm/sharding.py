"""Shards of about equal size by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, text_of
from quire.operators.skew import cut_lineage

HEADS = 16_384
PARCELS = 4_096


def least_loaded(loads: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest first, each to the shard with the least load so far (then the lowest number)."""
    heap = [(0, shard) for shard in range(shards)]
    chosen = {}
    for size, name in sorted(loads, key=lambda load: (-load[0], load[1])):
        load, shard = heapq.heappop(heap)
        chosen[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return chosen


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of
    ``docs(doc_id, text)``; other columns are ignored.

    Law ``bytes``: sizes are near equal. Equal texts stay together (null counts as empty),
    however many there are. A group with more than 1/16,384 of all bytes is scheduled by
    itself: there are fewer than 16,384 of those, whatever the input. All smaller groups
    are put into 4,096 parcels by a hash, which are scheduled like groups. So the heap on
    the driver has a bounded number of entries, and no shard is above the mean by more than
    the last entry it took. Slots run from 0 within a shard, by text and doc_id; repeated
    rows get a slot each. A table without rows gives none.
    """
    spark = docs.sparkSession
    text = text_of()
    rows = cut_lineage(docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("content"),
    ), "shard-rows")
    groups = cut_lineage(rows.groupBy("content").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * HEADS > F.lit(total)
    parcel = F.pmod("content", F.lit(PARCELS)).cast("int")
    heads = groups.where(large).select(F.col("content").cast("string").alias("name"), "bytes")
    rest = groups.where(~large).groupBy(parcel.alias("parcel")).agg(F.sum("bytes").alias("bytes"))
    parcels = rest.select(F.concat(F.lit("p"), F.col("parcel")).alias("name"), "bytes")
    chosen = least_loaded(
        [(row["bytes"], row["name"]) for row in heads.unionAll(parcels).collect()], shards)

    alone = [(int(name), place) for name, place in chosen.items() if name[0] != "p"]
    packed = [(int(name[1:]), place) for name, place in chosen.items() if name[0] == "p"]
    of_group = spark.createDataFrame(alone, "content long, of_group int")
    of_parcel = spark.createDataFrame(packed, "parcel int, of_parcel int")
    # fewer than HEADS and at most PARCELS rows
    dealt = (
        rows.withColumn("parcel", parcel)
        .join(F.broadcast(of_group), "content", "left")
        .join(F.broadcast(of_parcel), "parcel", "left")
        .withColumn("shard", F.coalesce("of_group", "of_parcel"))
        .select("doc_id", "size", "text_crc32", "content", "shard"))
    slots = numbered(dealt, "shard", ["content", "doc_id"], "slot", "shard-slots")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
