"""Manifests as JSON: ``{"version": …, "files": {hash: record}}``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.options import Options
from quire.schemas import LEDGER, MANIFEST, MANIFEST_ENTRY
from quire.sources import json_blocks

LARGE = 64 << 20
_ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def is_missing(problem: AnalysisException) -> bool:
    return problem.getCondition() == "PATH_NOT_FOUND"


def read_manifest(
    spark: SparkSession, path: str, one_object_per_file: bool = True, seq: int = 0,
    in_blocks: bool | None = None, block_bytes: int = json_blocks.BLOCK_BYTES,
) -> DataFrame:
    """Ledger rows of one or many manifest files; none if there is no such path.

    A manifest written as one big (indented) object is read by one task per file, or, with
    ``in_blocks``, in blocks by many tasks (see ``json_blocks``), with the same rows. Unless
    told otherwise, it is read in blocks if a file is above ``LARGE`` bytes; compressed files
    cannot be. ``write_manifest`` puts one object per line; read those
    with ``one_object_per_file=False``. Broken JSON fails the job; files without a byte have
    no records, as Spark's scans leave them out.
    """
    reader = spark.read.schema(MANIFEST).option("mode", "FAILFAST")
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "length")
        if one_object_per_file and (_are_large(files) if in_blocks is None else in_blocks):
            entries = _entries_in_blocks(files, block_bytes)
        else:
            objects = reader.option("multiLine", one_object_per_file).json(path)
            entries = objects.select(F.explode("files").alias("file_hash", "r"))
    except AnalysisException as problem:
        if is_missing(problem):
            return spark.createDataFrame([], LEDGER)
        raise
    return entries.select("file_hash", "r.*").select(
        *[_ledger_column(field, seq) for field in LEDGER])


def _are_large(files: DataFrame) -> bool:
    plain = files.where(~F.col("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$"))
    return not plain.where(F.col("length") > LARGE).isEmpty()


def _entries_in_blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    found, outlines = json_blocks.members(files, block_bytes)
    whole = F.from_json("text", MANIFEST, {"mode": "FAILFAST"})
    # an outline is what is left of a file without its records: one that is none fails here
    broken = outlines.where(whole.isNull()).first()
    if broken is not None:
        raise ValueError(f"malformed JSON: {broken['path']} is no object")
    entry = T.MapType(T.StringType(), MANIFEST_ENTRY)
    records = found.select(json_blocks.member_of(
        F.when(F.col("name") == "files", F.col("text")), entry).alias("entry"))
    return records.select(F.explode("entry").alias("file_hash", "r"))


def _ledger_column(field, seq: int):
    if field.name == "seq":
        return F.lit(seq).cast("long").alias("seq")
    return F.col(field.name).cast(field.dataType).alias(field.name)


def write_manifest(ledger: DataFrame, path: str, options: Options = Options()) -> None:
    """Each line is a manifest object with one record, so every task writes its share."""
    stamp = F.date_format("converted_at", _ISO_UTC)
    record = F.struct(
        "source_path", "source_filename", "source_size", "output_md", "output_attachments",
        "format", stamp.alias("converted_at"), "status", "error")
    lines = ledger.select(
        F.lit(options.ledger_version).alias("version"),
        F.create_map(F.col("file_hash"), record).alias("files"))
    lines.write.option("ignoreNullFields", False).json(path)
