"""EPUB reading, conversion by format, errors as rows."""

import pytest
from pyspark.sql import functions as F

from helpers import PICTURE, PNG, XHTML, book, docs, text_only, values
from quire.functions.epub import read_epub, saved_names
from quire.operators.convert import (
    attachments,
    convert,
    convert_html,
    convert_text,
    default_converters,
)
from quire.options import Options
from quire.sources.epub_items import epub_items


def test_items_of_a_container():
    title, items = read_epub(book())
    assert title == "Test Book"
    assert [(name, kind) for name, kind, _ in items] == [
        ("text/chap_01.xhtml", "document"), ("images/cover.png", "image")]


def test_item_order_can_be_that_of_the_spine():
    extra = [("a.xhtml", XHTML, b"<p>first</p>"), ("b.css", "text/css", b"")]
    content = book(spine=(2, 0), extra=extra)
    names = [name for name, _, _ in read_epub(content, "spine")[1]]
    assert names == ["a.xhtml", "text/chap_01.xhtml", "images/cover.png", "b.css"]


@pytest.mark.parametrize("names, saved", [
    (["a/x.png", "b/x.png", "x.png"], ["x.png", "x_1.png", "x_2.png"]),
    (["x.png", "x_1.png", "y/x.png"], ["x.png", "x_1.png", "x_2.png"]),
    (["x.png", "y/x.png", "x_1.png"], ["x.png", "x_1.png", "x_1_1.png"])])
def test_saved_names(names, saved):
    assert saved_names(names) == saved


def test_epub_to_markdown(spark):
    rows = convert(docs(spark, {"/in/test.epub": book(), "/in/n.epub": text_only()})).collect()
    found = {row["path"]: row for row in rows}
    full, plain = found["/in/test.epub"], found["/in/n.epub"]
    prefix = full["file_hash"][:8]
    assert full["status"] == "success" and full["error"] is None
    assert full["md"] == (
        f"# Chapter 1\nHello world.\n![Cover](attachments/{prefix}/cover.png)\n")
    assert (full["md_filename"], full["image_count"], full["hash_prefix"]) == (
        "Test Book.md", 1, prefix)
    assert plain["md"] == "Just text.\n" and plain["image_count"] == 0


def test_no_title_falls_back_to_the_stem(spark):
    content = book(title=None)
    row = convert(docs(spark, {"/in/my_document.epub": content})).first()
    assert row["md_filename"] == "my_document.md"


def test_image_names_are_kept_apart_and_counted(spark):
    extra = [("art/cover.png", PNG, b"other"), ("root.png", PNG, b"r")]
    done = convert(docs(spark, {"/in/a.epub": book(extra=extra)}))
    assert done.first()["image_count"] == 3
    assert values(attachments(done), "name", "source_name") == [
        ("cover.png", "images/cover.png"), ("cover_1.png", "art/cover.png"),
        ("root.png", "root.png")]
    bodies = {row["name"]: bytes(row["body"]) for row in attachments(done).collect()}
    assert bodies == {"cover.png": PICTURE, "cover_1.png": b"other", "root.png": b"r"}


def test_each_format_goes_to_its_converter_and_errors_stay_rows(spark):
    def picky(content):
        raise RuntimeError("cannot read this")

    files = {
        "/in/a.epub": book(), "/in/b.EPUB": book()[:300], "/in/c.txt": b"![x](images/y.png)",
        "/in/d.html": b"<h1>T</h1>", "/in/e.pdf": b"%PDF", "/in/f.doc": b"?", "/in/g.epub": b""}
    converters = default_converters() | {
        ".txt": convert_text, ".html": convert_html, ".pdf": picky}
    frame = docs(spark, files)
    rows = {row["path"][4:]: row for row in convert(frame, converters).collect()}
    assert {name: row["status"] for name, row in rows.items()} == {
        "a.epub": "success", "b.EPUB": "failed", "c.txt": "success", "d.html": "success",
        "e.pdf": "failed", "f.doc": "skipped", "g.epub": "failed"}
    assert rows["e.pdf"]["error"] == "cannot read this"
    assert rows["f.doc"]["error"] == "Unsupported format: .doc"
    assert rows["b.EPUB"]["error"] == "File is not a zip file"
    assert rows["c.txt"]["md"] == f"![x](attachments/{rows['c.txt']['file_hash'][:8]}/y.png)"
    assert rows["b.EPUB"]["md_filename"] is None and rows["d.html"]["md"] == "# T\n"


def test_a_document_without_bytes_fails(spark):
    content = F.when(F.col("path") == "/in/a.txt", F.col("content"))
    frame = docs(spark, {"/in/a.txt": b"abc", "/in/b.txt": b"abcd"}).withColumn("content", content)
    done = convert(frame, {".txt": convert_text})
    assert values(done, "path", "status") == [("/in/a.txt", "success"), ("/in/b.txt", "failed")]
    assert "size limit" in done.where("status = 'failed'").first()["error"]


def test_links_of_any_converter_follow_its_image_names(spark):
    def with_picture(content):
        return {"md": "![a](pic/a.png)", "images": [("pic/a.png", content)]}

    row = convert(docs(spark, {"/in/a.txt": b"abc"}), {".txt": with_picture}).first()
    assert row["md"] == f"![a](attachments/{row['hash_prefix']}/a.png)"
    assert row["images"][0]["name"] == "a.png"


def test_epub_items_as_rows(spark):
    found = epub_items(docs(spark, {"/in/a.epub": book(), "/in/b.epub": b"broken"}))
    assert values(found, "path", "item_pos", "name", "kind", F.length("body")) == [
        ("/in/a.epub", 0, "text/chap_01.xhtml", "document", len(read_epub(book())[1][0][2])),
        ("/in/a.epub", 1, "images/cover.png", "image", len(PICTURE)),
        ("/in/b.epub", None, None, None, None)]
    assert found.where("error is not null").count() == 1
