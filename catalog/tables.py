"""DataFrames that the queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import file_name, fingerprint, format_of, hash_prefix

RUN_AT = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_inbox(table(spark, sf_dir, "documents"))


def as_inbox(documents: DataFrame) -> DataFrame:
    """``documents`` as files: the language decides the ending."""
    ending = (
        F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".TXT")
        .when(F.col("lang") == "de", ".md").otherwise(".odt"))
    path = F.concat(F.lit("inbox/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ending)
    docs = documents.withColumn("path", path)
    return docs.withColumns({
        "source_filename": file_name(F.col("path")),
        "format": format_of(F.col("path")),
        "length": F.octet_length("text").cast("long"),
        "file_hash": fingerprint(F.col("text")),
    })


def narrow_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox(spark, sf_dir).select(
        "doc_id", "path", "source_filename", "length", "format", "file_hash")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox documents with a label; they are hashed before the join, so that it moves no
    text. ``draft_hash`` is that of an earlier version of the text."""
    draft = fingerprint(F.concat("text", F.lit(" (draft)")))
    docs = inbox(spark, sf_dir).withColumn("draft_hash", draft).drop("text")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of the labelled documents, in two generations.

    Documents that are not English were converted from an archive folder; for toxic ones the
    first record is about a draft, and good toxic ones got a second record.
    """
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    first = F.struct(
        F.when(toxic, F.col("draft_hash")).otherwise(F.col("file_hash")).alias("file_hash"),
        F.lit(1).cast("long").alias("seq"))
    second = F.struct("file_hash", F.lit(2).cast("long").alias("seq"))
    # one pass over the texts, whatever the number of generations
    generations = F.when(toxic & good, F.array(first, second)).otherwise(F.array(first))
    rows = labelled(spark, sf_dir).withColumn("g", F.explode(generations)).withColumns({
        "file_hash": F.col("g.file_hash"), "seq": F.col("g.seq")})
    archived = F.regexp_replace("path", "^inbox/", "archive/")
    return rows.select(
        F.when(F.col("lang") == "en", F.col("path")).otherwise(archived).alias("source_path"),
        "source_filename",
        F.col("length").alias("source_size"),
        "file_hash",
        F.when(good, F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).otherwise("")
        .alias("output_md"),
        F.when(good, F.concat(F.lit("attachments/"), hash_prefix(F.col("file_hash"))))
        .otherwise("").alias("output_attachments"),
        "format",
        F.lit(RUN_AT).cast("timestamp").alias("converted_at"),
        F.when(good, "success").otherwise("failed").alias("status"),
        F.when(~good, "Unexpected error: unreadable").alias("error"),
        "seq",
    )


def linked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a local, a plain local and an external image link each."""
    doc_id = F.col("doc_id").cast("string")
    md = F.concat(
        F.lit("![one](./images/"), doc_id, F.lit(".png)\n![two](images/b.jpg) "),
        F.col("text"), F.lit("\n![](http://h.example/q.png) ![x](art/"), doc_id, F.lit(".gif)"))
    return inbox(spark, sf_dir).withColumn("md", md)
