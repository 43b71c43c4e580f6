"""Result tables: Markdown texts and attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.convert import attachments
from quire.operators.layout import dedupe_names
from quire.operators.skew import cut_lineage, numbered_rows
from quire.sources.files import export_files

WRITERS = 4


def write_converted(converted: DataFrame, path: str) -> None:
    """The one table both kinds of output are read from: a text with its images.

    Keeping them together writes every byte once; reading one kind does not touch the
    other, as the files are columnar.
    """
    converted.write.mode("overwrite").parquet(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("status") == "success")
    return rows.select("path", "file_hash", "hash_prefix", "md_filename", "md", "image_count")


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    return attachments(spark.read.parquet(path))


def write_markdown(converted: DataFrame, path: str) -> None:
    """A table of its own: path, file_hash, md_filename, md, image_count."""
    rows = converted.where(F.col("status") == "success")
    rows.select("path", "file_hash", "md_filename", "md", "image_count").write.parquet(path)


def write_attachments(attachment_rows: DataFrame, path: str) -> None:
    """Folders by the first two characters of the hash prefix: at most 256 of them, each
    written by few tasks, among which a hash of the name spreads it."""
    shard = F.substring("hash_prefix", 1, 2)
    rows = attachment_rows.withColumn("shard", shard)
    salt = F.pmod(F.xxhash64("hash_prefix", "name"), F.lit(WRITERS))
    dealt = rows.repartition("shard", salt)
    dealt.write.partitionBy("shard").parquet(path)


def export_markdown(converted: DataFrame, folder: str) -> DataFrame:
    """Texts for people: ``converted(path, md_filename, md)`` as files of one folder. Where
    several documents have one name, all but the first by path get a number."""
    rows = converted.where(F.col("status") == "success").select(
        "path", "md_filename", "md", F.lit(0).alias("folder"))
    order = rows.select("folder", "path", "md_filename")
    placed = cut_lineage(numbered_rows(order, "path"), "export-order")
    named = dedupe_names(placed, "folder", "md_filename", "place", "name")
    bodies = rows.join(named.select(F.col("path").alias("_path"), "name"),
                       F.col("path") == F.col("_path"))
    return export_files(bodies.select("name", F.col("md").alias("body")), folder)


def export_attachments(attachment_rows: DataFrame, folder: str) -> DataFrame:
    """Images for people: ``attachments/<hash prefix>/<name>`` below a folder."""
    name = F.concat_ws("/", F.lit("attachments"), "hash_prefix", "name")
    return export_files(attachment_rows.select(name.alias("name"), "body"), folder)


def read_stored_attachments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("shard")
