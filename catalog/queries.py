"""One function per query: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.epubs import epubs_from_pages
from catalog.tables import (
    RUN_AT,
    as_inbox,
    inbox,
    labelled,
    ledger,
    linked_text,
    narrow_inbox,
    table,
)
from quire.functions import markup
from quire.functions.links import (
    is_external,
    local_image_refs,
    rewrite_local_links,
    rewrite_mapped_links,
)
from quire.functions.names import (
    file_name,
    file_stem,
    fingerprint,
    format_of,
    hash_prefix,
    is_supported,
    markdown_name,
    unsupported_reason,
)
from quire.functions.page_ranges import page_range, page_selected, slice_pages
from quire.operators import layout, validate
from quire.operators import ledger as ledgers
from quire.operators.convert import (
    attachments,
    convert,
    convert_html,
    convert_text,
    default_converters,
)
from quire.operators.skew import cut_lineage
from quire.options import Options
from quire.plans.run import Workspace
from quire.session import shared_folder, spread
from quire.sources import inbox as inbox_files
from quire.sources.epub_items import epub_items as explode_items
from quire.sources.file_states import FileStates
from quire.sources.files import export_files, hashed_by_path
from quire.sources.ledger_store import LedgerStore
from quire.sources.manifest import read_manifest, write_manifest
from quire.sources.output_tree import output_folders, remove_orphans
from quire.sources.output_tree import output_markdown as markdown_of_tree
from quire.sources.sinks import export_attachments, export_markdown
from quire.streaming.changes import changed_documents
from quire.streaming.ingest import start_conversion, start_ledger
from quire.streaming.upsert import start_ledger_upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TEXT_OPTIONS = Options(supported=(".txt", ".md"))


def query(function: Query) -> Query:
    """Registers a query under its name; a last ``_`` only sets it apart from a column."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _stored_ledger(spark, sf_dir):
    """The ledger as a run finds it: a table, not a query over the texts."""
    return cut_lineage(ledger(spark, sf_dir), "ledger")


# -- sources -----------------------------------------------------------------------


@query
def inbox_scan(spark, sf_dir):
    """Documents written as text files per language and source, scanned as an inbox."""
    folder = shared_folder(spark, "inbox")
    rows = table(spark, sf_dir, "documents").select("lang", "source", "text")
    rows.write.partitionBy("lang", "source").text(folder)
    files = inbox_files.supported(inbox_files.scan(spark, folder), Options(supported=(".txt",)))
    place = F.regexp_extract("path", r"(lang=[^/]*/source=[^/]*)/[^/]*$", 1)
    return files.groupBy(place.alias("folder"), "format").agg(F.sum("length").alias("bytes"))


@query
def epub_items(spark, sf_dir):
    docs = epubs_from_pages(table(spark, sf_dir, "pages"))
    return explode_items(docs).select(
        "path", "item_pos", "name", "kind", F.sha2("body", 256).alias("body_hash"), "error")


@query
def manifest_read(spark, sf_dir):
    """The ledger of the labels, written as JSON manifests and read back."""
    folder = shared_folder(spark, "manifest")
    write_manifest(ledger(spark, sf_dir), folder)
    return read_manifest(spark, folder, one_object_per_file=False).select(
        "source_path", "source_filename", "source_size", "file_hash", "output_md",
        "output_attachments", "format", _iso("converted_at"), "status", "error")


@query
def manifest_blocks(spark, sf_dir):
    """The ledger of the labels as one indented JSON object per status, read in small blocks."""
    folder = shared_folder(spark, "manifest")
    rows = ledger(spark, sf_dir).withColumn("converted_at", _iso("converted_at"))
    record = F.to_json(F.struct(
        "source_path", "source_filename", "source_size", "output_md", "output_attachments",
        "format", "converted_at", "status", "error"), {"pretty": "true", "ignoreNullFields": "false"})
    member = F.concat(F.lit('  "'), "file_hash", F.lit('": '), record)
    whole = rows.groupBy("status").agg(F.concat(
        F.lit('{\n "version": "1.0",\n "files": {\n'), F.array_join(F.collect_list(member), ",\n"),
        F.lit("\n }\n}\n")).alias("body"))
    export_files(whole.select(F.concat("status", F.lit(".json")).alias("name"), "body"), folder).count()
    return read_manifest(spark, folder, in_blocks=True, block_bytes=10_000).select(
        "source_path", "source_filename", "source_size", "file_hash", "output_md",
        "output_attachments", "format", _iso("converted_at"), "status", "error")


@query
def ledger_store(spark, sf_dir):
    """Two appended runs, a snapshot, and the second run repeated with other rows, which are
    the ones that count; then the current state."""
    store = LedgerStore(spark, shared_folder(spark, "ledger"))
    rows = _stored_ledger(spark, sf_dir)
    unfinished = rows.where("seq = 2 and source_size % 2 = 0").withColumns({
        "status": F.lit("failed"), "output_md": F.lit(""), "error": F.lit("interrupted")})
    store.append(rows.where("seq = 1"))
    store.append(unfinished, name="second")
    store.compact()
    store.append(rows.where("seq = 2"), name="second")
    return store.read().select("source_path", "file_hash", "output_md", "status", "error")


@query
def ledger_store_repeat(spark, sf_dir):
    """Runs that are repeated with other rows before and after merges, which rewrite only the
    buckets with news; the last attempt at each run counts."""
    store = LedgerStore(spark, shared_folder(spark, "ledger"), most_runs=2)
    rows = _stored_ledger(spark, sf_dir)
    wrong = rows.withColumns({"status": F.lit("failed"), "error": F.lit("interrupted")})
    store.append(wrong.where("seq = 1"), name="first")
    store.append(rows.where("seq = 1"), name="first")
    store.append(rows.where("seq = 2 and source_size % 3 = 0"))
    store.append(wrong.where("seq = 2 and source_size % 3 = 1"), name="second")
    store.append(rows.where("seq = 2 and source_size % 3 = 2"))
    store.append(rows.where("seq = 2 and source_size % 3 = 1"), name="second")
    return store.read().select("source_path", "file_hash", "output_md", "status", "error")


@query
def file_states(spark, sf_dir):
    """Pages as files, hashed, and hashed again: the second time by their states alone."""
    folder = shared_folder(spark, "pages")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"),
        F.coalesce("html", F.lit("")).alias("body"))
    export_files(pages, folder).count()
    states = FileStates(spark, shared_folder(spark, "states"))
    files = inbox_files.scan(spark, folder).select(
        "path", "source_filename", "length", "modificationTime")
    states.hashed(files, settled_seconds=0)
    again = states.hashed(files, settled_seconds=0)
    known = states.read().select("path", F.col("seq").alias("run"))
    return again.join(known, "path", "left").select(
        "source_filename", "length", "file_hash", "run")


def _tree(spark, sf_dir):
    """A converter's output tree: one file per document."""
    doc_id = F.col("doc_id").cast("string")
    base = F.concat(F.lit("/out/"), "source")
    path = (
        F.when(F.col("lang") == "es", F.concat(base, F.lit("/images/"), doc_id, F.lit(".png")))
        .when(F.col("lang") == "de", F.concat(base, F.lit("/auto/images/"), doc_id, F.lit(".png")))
        .when(F.col("lang") == "fr", F.concat(base, F.lit("/auto/"), "source", F.lit("-"), doc_id,
                                              F.lit(".md")))
        .otherwise(F.concat(base, F.lit("/"), doc_id, F.lit(".md"))))
    docs = table(spark, sf_dir, "documents")
    return docs.select(path.alias("path"), F.col("n_chars").alias("length"), "source", "doc_id")


@query
def output_tree(spark, sf_dir):
    return output_folders(_tree(spark, sf_dir), "/out")


@query
def output_markdown(spark, sf_dir):
    return markdown_of_tree(_tree(spark, sf_dir), "/out")


# -- columns -----------------------------------------------------------------------


def _page_path() -> F.Column:
    return F.regexp_extract("url", r"^([^?#]*)", 1)


@query
def format_counts(spark, sf_dir):
    formats = table(spark, sf_dir, "pages").select(format_of(_page_path()).alias("format"))
    return formats.groupBy("format").agg(F.count(F.lit(1)).alias("files"))


@query
def supported_split(spark, sf_dir):
    fits = is_supported(format_of(_page_path()), [".html"])
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(fits, "pending").otherwise("skipped").alias("status"),
        F.when(~fits, unsupported_reason(_page_path())).alias("error"))


@query
def fingerprint_(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", fingerprint(F.col("text")).alias("file_hash"))


@query
def hash_prefix_(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prefix = hash_prefix(fingerprint(F.col("text")))
    return docs.groupBy(prefix.alias("hash_prefix")).agg(F.count(F.lit(1)).alias("files"))


@query
def page_range_(spark, sf_dir):
    n, other = F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    pages = (
        F.when(F.col("lang") == "en", F.concat(F.lit(" "), other, F.lit(" - "), n, F.lit(" ")))
        .when(F.col("lang") == "fr", n)
        .when(F.col("lang") == "de", F.concat(n, F.lit("x"), other))
        .when(F.length("source") == 4, "")
        .otherwise(F.concat(F.lit("-"), n)))
    rows = table(spark, sf_dir, "documents").select("doc_id", pages.alias("pages"))
    return rows.select("doc_id", "pages", page_range(F.col("pages")).alias("r")).select(
        "doc_id", "pages", "r.*")


@query
def page_slice(spark, sf_dir):
    """Pages 2-4 of every document, a line being a page."""
    docs = table(spark, sf_dir, "documents").withColumn("r", page_range(F.lit("2-4")))
    kept = slice_pages(F.col("text"), F.col("r.start_page"), F.col("r.end_page"), "\n")
    return docs.select("doc_id", kept.alias("text"))


@query
def page_rows(spark, sf_dir):
    """Pages 2-3 of every conversation, a turn being a page."""
    turns = table(spark, sf_dir, "conversations").withColumn("r", page_range(F.lit("2-3")))
    kept = turns.where(page_selected(F.col("turn"), F.col("r.start_page"), F.col("r.end_page")))
    return kept.select("conv_id", "turn", "role", "text")


@query
def safe_filename(spark, sf_dir):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", markdown_name(file_stem(_page_path()), title).alias("from_title"),
        markdown_name(F.col("url")).alias("from_name"))


@query
def rewrite_links(spark, sf_dir):
    docs = linked_text(spark, sf_dir)
    prefix = F.concat(F.lit("attachments/"), hash_prefix(F.col("file_hash")))
    return docs.select("doc_id", rewrite_local_links(F.col("md"), prefix).alias("md"))


@query
def rewrite_links_mapped(spark, sf_dir):
    docs = linked_text(spark, sf_dir)
    prefix = F.concat(F.lit("attachments/"), hash_prefix(F.col("file_hash")))
    doc_id = F.col("doc_id").cast("string")
    names = F.create_map(
        F.concat(F.lit("./images/"), doc_id, F.lit(".png")), F.concat(F.lit("p"), doc_id),
        F.lit("b.jpg"), F.lit("b_1.jpg"))
    return docs.select(
        "doc_id", rewrite_mapped_links(F.col("md"), prefix, names).alias("md"))


@query
def image_refs(spark, sf_dir):
    docs = linked_text(spark, sf_dir)
    refs = docs.select("doc_id", F.explode(local_image_refs(F.col("md"))).alias("ref"))
    return refs.where(~is_external(F.col("ref")))


# -- conversion --------------------------------------------------------------------


def _pages_as_documents(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    content = F.encode("html", "UTF-8")
    docs = pages.select(
        "page_id", F.concat(F.lit("inbox/"), F.col("page_id").cast("string"), F.lit(".html"))
        .alias("path"), content.alias("content"))
    return inbox_files.with_format(docs).withColumns({
        "file_hash": F.sha2("content", 256), "length": F.length("content").cast("long")})


HTML_CONVERTERS = {".html": convert_html}


@query
def html_to_markdown(spark, sf_dir):
    """The parser, over every page."""
    return convert(_pages_as_documents(spark, sf_dir), HTML_CONVERTERS).select(
        "path", "status", "md")


@query
def html_to_markdown_sql(spark, sf_dir):
    """The expressions, over every page."""
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", markup.html_to_markdown(F.col("html")).alias("md"))


@query
def epub_to_markdown(spark, sf_dir):
    done = convert(epubs_from_pages(table(spark, sf_dir, "pages")))
    return done.select(
        "path", "status", "md_filename", "image_count",
        F.regexp_replace("md", "attachments/[0-9a-f]{8}/", "attachments/").alias("md"))


@query
def epub_images(spark, sf_dir):
    """The images of every EPUB; the two containers' hashes stay out of the comparison."""
    done = convert(epubs_from_pages(table(spark, sf_dir, "pages")))
    return attachments(done).select(
        "name", "source_name", F.sha2("body", 256).alias("body_hash"))


@query
def routed_convert(spark, sf_dir):
    """HTML pages, EPUBs and texts in one run; ``.odt`` has no converter."""
    columns = ["path", "file_hash", "format", "content"]
    texts = spread(table(spark, sf_dir, "documents"), "doc_id")
    texts = as_inbox(texts).withColumn("content", F.encode("text", "UTF-8"))
    docs = (
        _pages_as_documents(spark, sf_dir).select(*columns)
        .unionByName(epubs_from_pages(table(spark, sf_dir, "pages")).select(*columns))
        .unionByName(texts.select(*columns)))
    converters = default_converters() | HTML_CONVERTERS | {".txt": convert_text, ".md": convert_text}
    md = F.regexp_replace("md", "attachments/[0-9a-f]{8}/", "attachments/")
    return convert(docs, converters).select(
        "path", "format", "status", "error", "md_filename", "image_count",
        F.sha2(md, 256).alias("md_hash"))


@query
def convert_errors(spark, sf_dir):
    """EPUBs of pages that were fetched without encryption are cut in half."""
    docs = epubs_from_pages(table(spark, sf_dir, "pages"))
    half = F.expr("substring(content, 1, length(content) div 2)")
    broken = docs.withColumn(
        "content", F.when(F.col("url").startswith("http://"), half).otherwise(F.col("content")))
    return convert(broken).select("path", "status", "error", "md_filename", "image_count")


@query
def convert_quarantine(spark, sf_dir):
    """Pages fetched without encryption end their converter's process, those whose address has a
    length divisible by seven take all memory; each is one failed row, and all others are converted."""
    docs = _pages_as_documents(spark, sf_dir).join(
        table(spark, sf_dir, "pages").select(
            F.concat(F.lit("inbox/"), F.col("page_id").cast("string"), F.lit(".html"))
            .alias("path"), "url"), "path")
    kind = F.when(F.col("url").startswith("http://"), F.lit("exit")).when(
        F.length("url") % 7 == 0, F.lit("memory")).otherwise(F.lit(""))
    marked = docs.withColumn("content", F.concat(F.encode(kind, "UTF-8"), F.col("content")))

    def poisoned(content: bytes) -> dict:
        import os
        if content.startswith(b"exit"):
            os._exit(7)
        if content.startswith(b"memory"):
            bytearray(1 << 40)
        return convert_html(content)

    limits = Options(document_seconds=60, document_memory=1 << 30)
    done = convert(marked, {".html": poisoned}, limits)
    return done.select("path", "status", "error", "image_count")


@query
def page_links(spark, sf_dir):
    hrefs = F.regexp_extract_all("html", F.lit(r'<a [^>]*?href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(hrefs).alias("pos", "href"))


# -- ledger ------------------------------------------------------------------------


def _iso(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query
def manifest_record(spark, sf_dir):
    good = F.col("quality") == 1
    results = labelled(spark, sf_dir).select(
        "path", "source_filename", "length", "file_hash", "format",
        F.when(good, "success").otherwise("failed").alias("status"),
        F.when(~good, "Unexpected error: unreadable").alias("error"),
        markdown_name(file_stem(F.col("path"))).alias("md_filename"))
    records = ledgers.build_records(results, F.lit(RUN_AT), 3)
    return records.withColumn("converted_at", _iso("converted_at"))


@query
def manifest_upsert(spark, sf_dir):
    rows = _stored_ledger(spark, sf_dir)
    again = rows.where("status = 'failed'").withColumns({
        "status": F.lit("success"), "error": F.lit(None).cast("string"),
        "output_md": F.concat("source_filename", F.lit(".md")),
        "seq": F.lit(3).cast("long")})
    merged = ledgers.upsert(rows, again)
    return merged.select("source_path", "file_hash", "output_md", "status", "error", "seq")


def _hashed(spark, sf_dir):
    return cut_lineage(narrow_inbox(spark, sf_dir), "hashed")


@query
def incremental_plan(spark, sf_dir):
    states = ledgers.classify(_hashed(spark, sf_dir), _stored_ledger(spark, sf_dir))
    return states.select("path", "file_hash", "state")


@query
def moved_files(spark, sf_dir):
    states = ledgers.classify(_hashed(spark, sf_dir), _stored_ledger(spark, sf_dir))
    return states.where("state = 'moved'").select("path", "file_hash")


@query
def retry_plan(spark, sf_dir):
    options = Options(supported=(".txt", ".md"), retry_failed=True)
    plan = ledgers.build_plan(_hashed(spark, sf_dir), _stored_ledger(spark, sf_dir), options)
    return plan.select("path", "action", "reason")


@query
def plan(spark, sf_dir):
    rows = ledgers.build_plan(_hashed(spark, sf_dir), _stored_ledger(spark, sf_dir), TEXT_OPTIONS)
    return rows.select("path", "file_hash", "action", "reason")


@query
def pending(spark, sf_dir):
    docs = _hashed(spark, sf_dir)
    rows = ledgers.build_plan(docs, _stored_ledger(spark, sf_dir), TEXT_OPTIONS)
    return ledgers.pending(docs, rows).select("path", "file_hash")


@query
def pending_forced(spark, sf_dir):
    docs = _hashed(spark, sf_dir)
    options = Options(supported=(".txt", ".md"), force=True)
    rows = ledgers.build_plan(docs, _stored_ledger(spark, sf_dir), options)
    return ledgers.pending(docs, rows).select("path", "file_hash")


def _current(spark, sf_dir):
    return ledgers.last_per(ledger(spark, sf_dir), *ledgers.KEY)


@query
def status(spark, sf_dir):
    return ledgers.status(_current(spark, sf_dir))


@query
def converted_list(spark, sf_dir):
    rows = ledgers.converted_list(_current(spark, sf_dir))
    return rows.withColumn("converted_at", _iso("converted_at"))


@query
def failed_list(spark, sf_dir):
    return ledgers.failed_list(_current(spark, sf_dir))


def _results(spark, sf_dir):
    """Every document: labelled ones succeeded or failed, the others were skipped."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    state = (
        F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failed")
        .otherwise("skipped"))
    return docs.select("doc_id", state.alias("status"))


@query
def batch_stats(spark, sf_dir):
    return ledgers.batch_stats(_results(spark, sf_dir))


@query
def batch_report_json(spark, sf_dir):
    return ledgers.as_json(ledgers.batch_stats(_results(spark, sf_dir)))


# -- layout ------------------------------------------------------------------------


@query
def best_markdown(spark, sf_dir):
    files = markdown_of_tree(_tree(spark, sf_dir), "/out")
    return layout.best_markdown(files, "subdir", "md_file", "length")


def _image_names(spark, sf_dir, name):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", name.alias("name"))


@query
def dedupe_names(spark, sf_dir):
    files = _image_names(spark, sf_dir, F.concat("lang", F.lit(".png")))
    return layout.dedupe_names(files, "source", "name", "doc_id")


@query
def dedupe_names_buckets(spark, sf_dir):
    """The same with buckets so short that a group is spread over several tasks."""
    files = _image_names(spark, sf_dir, F.concat("lang", F.lit(".png")))
    return layout.dedupe_names(files, "source", "name", "doc_id", rows_per_bucket=10)


@query
def dedupe_names_clash(spark, sf_dir):
    """Names that already look like a suffixed name of another file."""
    ending = (
        F.when(F.col("n_chars") > 3000, "_1.png").when(F.col("n_chars") > 2000, "_2.png")
        .when(F.col("n_chars") > 1500, "_1_1.png").otherwise(".png"))
    files = _image_names(spark, sf_dir, F.concat("lang", ending))
    return layout.dedupe_names(files, "source", "name", "doc_id")


@query
def name_collisions(spark, sf_dir):
    """Markdown names by title that several pages share."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("url", "//([^/]*)", 1)
    rows = pages.select(
        F.col("page_id").cast("string").alias("path"), markdown_name(title).alias("md_filename"))
    return layout.flag_name_collisions(rows)


@query
def image_files(spark, sf_dir):
    """The files of an output tree that count as images."""
    return layout.image_files(_tree(spark, sf_dir), "path").select("path", "length")


@query
def group_fingerprint(spark, sf_dir):
    return layout.group_fingerprint(
        _group_files(spark, sf_dir), "source", "path", "name", "size")


def _group_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(
        "source", F.concat("lang", F.lit("/"), name).alias("path"), name.alias("name"),
        F.col("n_chars").alias("size"))


@query
def orphan_outputs(spark, sf_dir):
    outputs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return layout.orphan_outputs(outputs, table(spark, sf_dir, "labels"), "doc_id")


@query
def orphans_removed(spark, sf_dir):
    """Pages in a tree of folders, of which some are not kept: what was removed, and how many
    files are left in each folder."""
    folder = shared_folder(spark, "tree")
    number = (F.col("page_id") % 10).cast("string")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("n"), number, F.lit("/"), F.col("page_id").cast("string"), F.lit(".md"))
        .alias("name"), F.coalesce("html", F.lit("")).alias("body"))
    export_files(pages, folder).count()
    every = pages.select(F.regexp_extract("name", "^([^/]*)/", 1).alias("name")).distinct()
    gone = remove_orphans(spark, folder, every.where("name < 'n7'")).select(
        file_name(F.col("path")).alias("name"), "removed")
    place = F.regexp_extract("path", "/(n[0-9])/[^/]*$", 1)
    left = inbox_files.scan(spark, folder).groupBy(place.alias("name")).agg(
        F.count(F.lit(1)).alias("files"))
    return every.join(gone, "name", "left").join(left, "name", "left").select(
        "name", F.coalesce("removed", F.lit(False)).alias("removed"),
        F.coalesce("files", F.lit(0)).alias("files"))


def _read_back(exported, pattern):
    """The files that were written, opened by their paths in tasks: a listing of them would
    pass through the driver. As in a scan of the folder, empty and hidden ones are left out."""
    parts = int(exported.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = exported.where((F.col("bytes") > 0) & ~F.col("path").rlike("/[._][^/]*$"))
    paths = seen.select("path").repartition(parts, "path").distinct()
    return hashed_by_path(paths).select(
        F.regexp_extract("path", pattern, 0).alias("name"),
        F.col("file_hash").alias("content_hash"))


@query
def markdown_sink(spark, sf_dir):
    """Texts written as files of one folder, many by the same name, and read back."""
    folder = shared_folder(spark, "export")
    rows = inbox(spark, sf_dir).select(
        "path", F.concat("source", F.lit(".md")).alias("md_filename"), F.col("text").alias("md"),
        F.lit("success").alias("status"))
    exported = cut_lineage(export_markdown(rows, folder), "exported")
    return _read_back(exported, "[^/]*$")


@query
def attachment_sink(spark, sf_dir):
    """Images written below their hash prefix, and read back."""
    folder = shared_folder(spark, "export")
    rows = inbox(spark, sf_dir).select(
        hash_prefix(F.col("file_hash")).alias("hash_prefix"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("name"),
        F.col("text").cast("binary").alias("body"))
    exported = cut_lineage(export_attachments(rows, folder), "exported")
    return _read_back(exported, "attachments/[^/]*/[^/]*$")


# -- validation --------------------------------------------------------------------


def _checked(spark, sf_dir):
    """Ledger, links, attachment groups and files: all documents are recorded, the labelled
    ones have a text, of those the clean ones a group and the good ones their image."""
    doc_id = F.col("doc_id").cast("string")
    prefix = F.concat(F.lit("attachments/"), hash_prefix(F.col("file_hash")))
    image = F.concat(prefix, F.lit("/"), doc_id, F.lit(".png"))
    output_md = F.concat(doc_id, F.lit(".md"))
    docs = inbox(spark, sf_dir)
    records = cut_lineage(docs.select(
        F.col("path").alias("source_path"), "file_hash",
        F.when(F.col("lang") == "es", "").otherwise(output_md).alias("output_md"),
        prefix.alias("output_attachments")), "records")
    md = F.concat(
        F.lit("![a]("), image, F.lit(") ![b](http://h.example/x.png)\n"), "text",
        F.lit("\n![c]("), prefix, F.lit("/b.jpg)"))
    texts = docs.select(output_md.alias("output_md"), md.alias("md"))
    kept = labelled(spark, sf_dir)
    markdown = kept.select(output_md.alias("output_md"))
    all_links = validate.image_links(texts, "output_md")
    links = cut_lineage(all_links.join(markdown, "output_md", "left_semi"), "links")
    groups = kept.where("toxic = 0").select(prefix.alias("output_attachments"))
    files = kept.where("quality = 1").select(image.alias("ref"))
    return records, markdown, links, groups, files


@query
def missing_outputs(spark, sf_dir):
    records, markdown, _, groups, _ = _checked(spark, sf_dir)
    return validate.missing_outputs(records, markdown, groups).drop("times")


@query
def dangling_refs(spark, sf_dir):
    _, _, links, _, files = _checked(spark, sf_dir)
    return validate.ref_findings(validate.dangling_refs(links, files)).drop("times")


@query
def validation_summary(spark, sf_dir):
    records, markdown, links, groups, files = _checked(spark, sf_dir)
    findings = validate.validate(records, markdown, links, groups, files)
    return validate.summary(findings, records)


# -- whole runs and streams --------------------------------------------------------


def _first_run(spark, sf_dir):
    workspace = Workspace(
        spark, shared_folder(spark, "workspace"), Options(supported=(".html",)), HTML_CONVERTERS)
    docs = _pages_as_documents(spark, sf_dir)
    return workspace, docs, workspace.convert(docs, F.lit(RUN_AT))


@query
def convert_run(spark, sf_dir):
    """Plan, convert, record: the results of a first run over all pages."""
    _, _, results = _first_run(spark, sf_dir)
    return results.select("path", "file_hash", "status", "error", "md_filename", "image_count")


@query
def convert_run_documents(spark, sf_dir):
    """A run over documents with copies, formats without support, and texts that fail."""
    def picky(content):
        if len(content) % 7 == 0:
            raise ValueError("unreadable")
        return convert_text(content)

    docs = inbox(spark, sf_dir).withColumn("content", F.col("text").cast("binary"))
    workspace = Workspace(
        spark, shared_folder(spark, "workspace"), TEXT_OPTIONS, {".txt": picky, ".md": picky})
    results = workspace.convert(docs, F.lit(RUN_AT))
    return results.select("path", "file_hash", "status", "error", "md_filename", "reason")


@query
def convert_run_again(spark, sf_dir):
    """The plan after that run: nothing is left to do."""
    workspace, docs, _ = _first_run(spark, sf_dir)
    return workspace.plan(docs).select("path", "action", "reason")


@query
def convert_run_status(spark, sf_dir):
    workspace, _, _ = _first_run(spark, sf_dir)
    return workspace.status()


@query
def convert_run_validation(spark, sf_dir):
    """The check of the outputs of that run."""
    workspace, _, _ = _first_run(spark, sf_dir)
    return validate.summary(workspace.validate(), workspace.ledger.read())


@query
def stream_convert(spark, sf_dir):
    """Pages arrive as files of a stream and are converted once each."""
    folder = shared_folder(spark, "stream")
    _pages_as_documents(spark, sf_dir).write.parquet(f"{folder}/in")
    arriving = spark.read.parquet(f"{folder}/in").schema
    docs = spark.readStream.schema(arriving).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    running = start_conversion(docs, f"{folder}/out", f"{folder}/checkpoint", HTML_CONVERTERS)
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("path", "status", "md")


@query
def stream_changes(spark, sf_dir):
    """Pages as files, of which some are changed in place: how often a stream delivers each."""
    folder = shared_folder(spark, "changes")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"),
        F.coalesce("html", F.lit("")).alias("body"))
    longer = pages.where("page_id % 5 = 0").withColumn("body", F.concat("body", F.lit("<!-- -->")))
    for some in (pages, longer):
        export_files(some, f"{folder}/in").count()
        docs = changed_documents(spark, f"{folder}/in", f"{folder}/state", files_per_batch=1000)
        docs.writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(
        ).awaitTermination()
    delivered = spark.read.parquet(f"{folder}/out")
    return delivered.groupBy(file_name(F.col("path")).alias("source_filename")).agg(
        F.count(F.lit(1)).alias("times"), F.max("length").alias("length"))


@query
def stream_ledger(spark, sf_dir):
    """Ledger rows arrive generation by generation; the last one wins."""
    folder = shared_folder(spark, "stream")
    rows = _stored_ledger(spark, sf_dir)
    store = LedgerStore(spark, f"{folder}/ledger")
    for generation in (1, 2):
        rows.where(F.col("seq") == generation).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        start_ledger(arriving, store, f"{folder}/checkpoint").awaitTermination()
    return store.read().select("source_path", "file_hash", "output_md", "status", "error")


@query
def stream_upsert(spark, sf_dir):
    """Ledger rows in three batches, of which the last says nothing new: the changes come from
    a state store, and only they become runs."""
    folder = shared_folder(spark, "stream")
    rows = _stored_ledger(spark, sf_dir)
    store = LedgerStore(spark, f"{folder}/ledger")
    for some in (rows.where("seq = 1"), rows.where("seq = 2"), ledgers.last_per(rows, "source_path")):
        some.write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        start_ledger_upsert(arriving, store, f"{folder}/checkpoint").awaitTermination()
    return store.read().select(
        "source_path", "file_hash", "output_md", "status", "error", F.col("seq").alias("run"))
