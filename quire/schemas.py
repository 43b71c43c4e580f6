"""Schemas of the tables that are stored or cross the Python boundary."""

from __future__ import annotations

from pyspark.sql import types as T

LEDGER = T.StructType([
    T.StructField("source_path", T.StringType()),
    T.StructField("source_filename", T.StringType()),
    T.StructField("source_size", T.LongType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("output_md", T.StringType()),
    T.StructField("output_attachments", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("converted_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("seq", T.LongType()),
])

# One entry of a JSON manifest; the content hash is the map key there.
MANIFEST_ENTRY = T.StructType([
    T.StructField("source_path", T.StringType()),
    T.StructField("source_filename", T.StringType()),
    T.StructField("source_size", T.LongType()),
    T.StructField("output_md", T.StringType()),
    T.StructField("output_attachments", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("converted_at", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("files", T.MapType(T.StringType(), MANIFEST_ENTRY)),
])

# What is known of a file without opening it again.
FILE_STATE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("modified_at", T.TimestampType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("seq", T.LongType()),
])

IMAGE = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("body", T.BinaryType()),
])

# What the Python stage returns per document.
PARSED = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("md", T.StringType()),
    T.StructField("images", T.ArrayType(IMAGE)),
    T.StructField("name_map", T.MapType(T.StringType(), T.StringType())),
])

EPUB_ITEM = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("item_pos", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("body", T.BinaryType()),
    T.StructField("error", T.StringType()),
])
