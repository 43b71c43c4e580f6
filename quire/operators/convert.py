"""Conversion: documents to Markdown, one converter per format, errors kept as rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.batches import batches
from quire.functions.epub import read_epub, saved_names
from quire.functions.guarded import Guard
from quire.functions.html import html_to_markdown
from quire.functions.links import rewrite_local_links, rewrite_mapped_links
from quire.functions.names import (
    file_stem,
    hash_prefix,
    markdown_name,
    unsupported_reason,
)
from quire.options import Options
from quire.schemas import PARSED
from quire.sources.files import read_path

# A converter turns bytes into {"md": text} and may add "title" and
# "images": [(name used in the text, bytes)].
Converter = Callable[[bytes], dict]

CHAPTER_BREAK = "\n\n"
CHANGED = "changed during the run"
# Arrow lists of bytes end at 2 GB; a result above that becomes an error of its row.
LARGEST_ROW = (1 << 31) - (1 << 20)
TASK_BYTES = 128 << 20


def convert_html(content: bytes) -> dict:
    return {"md": html_to_markdown(content.decode("utf-8", errors="replace"))}


def convert_text(content: bytes) -> dict:
    """For Markdown and plain text, which are kept as they are."""
    return {"md": content.decode("utf-8", errors="replace")}


def epub_converter(order: str = "manifest") -> Converter:
    def convert(content: bytes) -> dict:
        title, items = read_epub(content, order, kinds=("document", "image"))
        chapters = [
            html_to_markdown(body.decode("utf-8", errors="replace"))
            for _, kind, body in items if kind == "document"
        ]
        images = [(name, body) for name, kind, body in items if kind == "image"]
        return {"title": title, "md": CHAPTER_BREAK.join(chapters), "images": images}

    return convert


def default_converters(options: Options = Options()) -> dict[str, Converter]:
    return {".epub": epub_converter(options.item_order)}


def parse(
    docs: DataFrame, converters: Mapping[str, Converter], by_path: bool = False,
    check_hash: bool = False, seconds: float | None = None, memory: int | None = None,
) -> DataFrame:
    """The Python stage: ``docs(path, file_hash, format, content)`` to ``PARSED`` rows.

    With ``by_path``, ``docs`` needs no content: the task opens the path itself. With
    ``check_hash``, bytes that do not have the SHA-256 ``file_hash`` are an error. A document
    that its converter cannot read becomes a ``failed`` row with the error text; the rest of
    the batch goes on. One of an unknown format becomes ``skipped``.

    With ``seconds`` or ``memory``, converters run in a child process of the task (see
    ``Guard``): a document that takes longer, needs more bytes or ends the process is a
    ``failed`` row as well, and never the end of the job.
    """
    schema = to_arrow_schema(PARSED)
    table = dict(converters)

    def row(call, path, file_hash, fmt, content=None) -> dict:
        base = {"path": path, "file_hash": file_hash, "format": fmt}
        if fmt not in table:
            return base | {"status": "skipped"}
        try:
            if by_path:
                content = read_path(path)
            if content is None:
                raise ValueError("no content, or larger than the size limit")
            if check_hash and hashlib.sha256(content).hexdigest() != file_hash:
                raise ValueError(CHANGED)
            found = call(fmt, content)
            names = [name for name, _ in found.get("images", ())]
            saved = saved_names(names)
            images = [
                {"pos": pos, "source_name": name, "name": new, "body": body}
                for pos, ((name, body), new) in enumerate(zip(found.get("images", ()), saved))
            ]
            lookup = {}
            for name, new in zip(names, saved):
                lookup[name] = lookup[name.rsplit("/", 1)[-1]] = new
            done = base | {
                "status": "success", "title": found.get("title"), "md": found["md"],
                "images": images, "name_map": list(lookup.items()),
            }
            if size_of(done) > LARGEST_ROW:
                raise ValueError("the converted document does not fit into a row")
            return done
        except Exception as problem:
            return base | {"status": "failed", "error": str(problem) or type(problem).__name__}

    def size_of(result: dict) -> int:
        bodies = sum(len(image["body"]) for image in result.get("images", ()))
        return len(result.get("md") or "") + bodies

    def stage(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guarded = seconds is not None or memory is not None
        call = Guard(table, seconds, memory) if guarded else lambda fmt, body: table[fmt](body)
        rows = (
            row(call, *values)
            for batch in incoming
            for values in zip(*(column.to_pylist() for column in batch.columns))
        )
        try:
            yield from batches(rows, schema, size_of)
        finally:
            if guarded:
                call.close()

    columns = ["path", "file_hash", "format"] + ([] if by_path else ["content"])
    return docs.select(*columns).mapInArrow(stage, PARSED)


def finish(parsed: DataFrame, options: Options = Options()) -> DataFrame:
    """Native steps after the Python stage: file name, link rewrite, image count."""
    prefix = attachments_path(F.col("file_hash"), options)
    mapped = rewrite_mapped_links(
        F.col("md"), prefix, F.col("name_map"), options.keep_external_images
    )
    local = rewrite_local_links(F.col("md"), prefix)
    name = markdown_name(file_stem(F.col("path")), F.col("title"))
    return parsed.select(
        "path",
        "file_hash",
        "format",
        "status",
        F.when(F.col("status") == "skipped", unsupported_reason(F.col("path")))
        .otherwise(F.col("error")).alias("error"),
        "title",
        F.when(F.col("status") == "success", name).alias("md_filename"),
        # a converter that has images names them as its text does, whatever the format
        F.when(F.size("name_map") > 0, mapped).otherwise(local).alias("md"),
        F.when(F.col("status") != "skipped", F.coalesce(F.size("images"), F.lit(0)))
        .alias("image_count"),
        hash_prefix(F.col("file_hash"), options.hash_prefix_length).alias("hash_prefix"),
        "images",
    )


def convert(
    docs: DataFrame, converters: Mapping[str, Converter] | None = None,
    options: Options = Options(), check_hash: bool = False,
) -> DataFrame:
    """Convert ``docs(path, file_hash, format, content)``, each format by its converter.

    Formats without a converter become ``skipped`` rows, and their bytes stay out of the
    Python stage. A document without content becomes ``failed``.
    """
    table = dict(converters) if converters is not None else default_converters(options)
    known = F.col("format").isin(*table)
    bounded = docs.withColumn("content", F.when(known, F.col("content")))
    parsed = parse(
        bounded, table, check_hash=check_hash, seconds=options.document_seconds,
        memory=options.document_memory)
    return finish(parsed, options)


def convert_files(
    files: DataFrame, converters: Mapping[str, Converter] | None = None,
    options: Options = Options(),
) -> DataFrame:
    """Converts ``files(path, file_hash, format, length)`` by opening their paths in the
    tasks: only narrow rows are shuffled, to spread the work, and only these files are read.
    A file that no longer has ``file_hash`` becomes a ``failed`` row.
    """
    table = dict(converters) if converters is not None else default_converters(options)
    total = files.agg(F.sum("length")).first()[0] or 0
    cores = files.sparkSession.sparkContext.defaultParallelism
    dealt = files.repartition(max(cores, -(-total // TASK_BYTES)), "file_hash")
    parsed = parse(
        dealt, table, by_path=True, check_hash=True, seconds=options.document_seconds,
        memory=options.document_memory)
    return finish(parsed, options)


def attachments_path(file_hash: Column, options: Options = Options()) -> Column:
    prefix = hash_prefix(file_hash, options.hash_prefix_length)
    return F.concat(F.lit(options.attachments_dir + "/"), prefix)


def attachments(converted: DataFrame) -> DataFrame:
    """One row per image of the converted documents."""
    exploded = converted.select("hash_prefix", "file_hash", F.explode("images").alias("image"))
    return exploded.select(
        "hash_prefix", "file_hash", F.col("image.name").alias("name"),
        F.col("image.source_name").alias("source_name"), F.col("image.body").alias("body"),
    )

