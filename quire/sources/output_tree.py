"""The output tree of an external converter: a folder per document, with Markdown files
somewhere below it and possibly an ``images`` folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import file_name
from quire.operators.layout import orphan_outputs
from quire.operators.skew import cut_lineage
from quire.sources.files import remove_paths

IMAGES = "images"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of all files below ``root``; no bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def _below(root: str) -> Column:
    """The parts of the path below ``root``."""
    start = len(root.rstrip("/")) + 2
    return F.split(F.substring(F.col("path"), start, F.lit(2**31 - 1)), "/")


def with_folders(files: DataFrame, root: str) -> DataFrame:
    """Adds ``subdir`` (first level), and whether a file is Markdown or an image of it.

    Files that lie directly in ``root`` belong to no document and are left out.
    """
    parts = _below(root)
    base = root.rstrip("/") + "/"
    return files.withColumn("_parts", parts).where(F.size("_parts") > 1).select(
        "path", "length",
        F.concat(F.lit(base), F.get("_parts", F.lit(0))).alias("subdir"),
        F.col("path").endswith(".md").alias("is_markdown"),
        ((F.size("_parts") > 2) & (F.get("_parts", F.lit(1)) == IMAGES)).alias("in_images"),
    )


def output_folders(files: DataFrame, root: str) -> DataFrame:
    """One row per folder: how many Markdown files it has, and its images folder or null."""
    folders = with_folders(files, root).groupBy("subdir").agg(
        F.count_if("is_markdown").alias("md_count"), F.bool_or("in_images").alias("_images"))
    images = F.when(F.col("_images"), F.concat("subdir", F.lit("/" + IMAGES)))
    return folders.select("subdir", "md_count", images.alias("images_dir"))


def output_markdown(files: DataFrame, root: str) -> DataFrame:
    """One row per Markdown file, with its folder."""
    found = with_folders(files, root).where("is_markdown")
    return found.select("subdir", F.col("path").alias("md_file"), "length")


def require_output(folders: DataFrame, root: str) -> DataFrame:
    """Fails if the converter wrote no folder at all."""
    if folders.limit(1).isEmpty():
        raise ValueError(f"No output subdirectories found in {root}")
    return folders


def remove_orphans(spark: SparkSession, root: str, keep: DataFrame) -> DataFrame:
    """Deletes the folders of a tree whose name is not in ``keep(name)`` and returns
    ``path, removed`` for each; a folder that cannot be deleted stays and does not count.

    Only called on purpose: no run deletes outputs. Folders without any file are not seen,
    and files directly in ``root`` stay. The deletion is done, once, when this returns.
    """
    folders = output_folders(list_tree(spark, root), root)
    named = folders.select(F.col("subdir").alias("path"), file_name(F.col("subdir")).alias("name"))
    orphans = orphan_outputs(named, keep, "name")
    return cut_lineage(remove_paths(orphans), "removed")
