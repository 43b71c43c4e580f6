"""Columns over names, links and page ranges."""

import hashlib
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from quire.functions.links import (
    image_refs,
    local_image_refs,
    rewrite_local_links,
    rewrite_mapped_links,
)
from quire.functions.names import (
    file_name,
    file_stem,
    file_suffix,
    fingerprint,
    format_of,
    hash_prefix,
    is_supported,
    markdown_name,
    unsupported_reason,
)
from quire.functions.page_ranges import page_range, page_selected, slice_pages


def one(spark, column, **inputs):
    frame = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("path", [
    "/a/b.PDF", "/a/b.tar.gz", "/a/.hidden", "/a/none", "x.epub", "/a.b/c", "/a/..b.c", "/a/b c.Png"])
def test_name_parts_are_those_of_pathlib(spark, path):
    expected = PurePosixPath(path)
    assert one(spark, file_name(F.col("p")), p=path) == expected.name
    assert one(spark, file_suffix(F.col("p")), p=path) == expected.suffix
    assert one(spark, file_stem(F.col("p")), p=path) == expected.stem
    assert one(spark, format_of(F.col("p")), p=path) == expected.suffix.lower()


def test_support_ignores_case_and_the_reason_keeps_it(spark):
    fits = is_supported(format_of(F.col("p")), [".PDF", ".epub"])
    assert one(spark, fits, p="a.pdf") and one(spark, fits, p="a.PDF")
    assert not one(spark, fits, p="a.txt")
    assert one(spark, unsupported_reason(F.col("p")), p="a.TXT") == "Unsupported format: .TXT"


def test_fingerprint_and_prefix(spark):
    digest = hashlib.sha256(b"hello world").hexdigest()
    assert one(spark, fingerprint(F.col("t")), t="hello world") == digest
    assert one(spark, hash_prefix(fingerprint(F.col("t"))), t="hello world") == digest[:8]


@pytest.mark.parametrize("title, stem, name", [
    ("Test Book", "x", "Test Book.md"), (None, "my_document", "my_document.md"),
    ("", "my_document", "my_document.md"), (None, "bad:name?", "bad_name_.md"),
    ('a\\b/c:d*e?f"g<h>i|j', "x", "a_b_c_d_e_f_g_h_i_j.md"), ("  t  ", "x", "t.md"),
    ("é" * 200, "x", "é" * 128 + ".md")])
def test_markdown_name(spark, title, stem, name):
    assert one(spark, markdown_name(F.col("s"), F.col("t")), s=stem, t=title) == name


@pytest.mark.parametrize("md, out", [
    ("![alt](images/test.png)", "![alt](attachments/h/test.png)"),
    ("![other](./images/pic.jpg)", "![other](attachments/h/pic.jpg)"),
    ("No images here. [link](images/x.png)", "No images here. [link](images/x.png)"),
    ("![a](http://x/images/y.png)", "![a](http://x/images/y.png)"),
    ("![a](images/x).png)", "![a](attachments/h/x).png)")])
def test_local_links(spark, md, out):
    assert one(spark, rewrite_local_links(F.col("m"), F.lit("attachments/h")), m=md) == out


def test_local_links_take_the_prefix_literally(spark):
    column = rewrite_local_links(F.col("m"), F.lit(r"a$1\b"))
    assert one(spark, column, m="![x](images/y)") == r"![x](a$1\b/y)"


@pytest.mark.parametrize("md, names, out", [
    ("![Cover](../images/cover.png)", {"images/cover.png": "cover.png", "cover.png": "cover.png"},
     "![Cover](p/cover.png)"),
    ("# T\n\n[link](http://x.com)\n\n![x](images/a.png)", {"images/a.png": "b.png"},
     "# T\n\n[link](http://x.com)\n\n![x](p/b.png)"),
    ("Just plain text.", {}, "Just plain text."),
    ("![img](some/unknown/path/fig.jpg)", {}, "![img](p/fig.jpg)"),
    ("![a](x/y.png)![b](y.png) z", {"x/y.png": "1.png", "y.png": "2.png"},
     "![a](p/1.png)![b](p/2.png) z"),
    ("![](http://h/q.png)", {}, "![](p/q.png)")])
def test_mapped_links(spark, md, names, out):
    frame = spark.createDataFrame([(md, names)], "m string, n map<string,string>")
    column = rewrite_mapped_links(F.col("m"), F.lit("p"), F.col("n"))
    assert frame.select(column.alias("v")).first()["v"] == out


def test_mapped_links_can_keep_external_ones(spark):
    frame = spark.createDataFrame([("![](http://h/q.png)![](a/b.png)",)], "m string")
    names = F.create_map().cast("map<string,string>")
    column = rewrite_mapped_links(F.col("m"), F.lit("p"), names, keep_external=True)
    assert frame.select(column).first()[0] == "![](http://h/q.png)![](p/b.png)"


def test_image_refs(spark):
    md = "![a](x.png) [b](c.png) ![](https://h/d.png)\n![e](f g.png)"
    assert one(spark, image_refs(F.col("m")), m=md) == ["x.png", "https://h/d.png", "f g.png"]
    assert one(spark, local_image_refs(F.col("m")), m=md) == ["x.png", "f g.png"]


@pytest.mark.parametrize("text, start, end", [
    ("3-5", 2, 4), ("3", 2, 2), ("1-100", 0, 99), ("", None, None), (None, None, None),
    (" 3 - 5 ", 2, 4), ("5-5", 4, 4)])
def test_page_ranges(spark, text, start, end):
    row = one(spark, page_range(F.col("p")), p=text)
    assert (row["start_page"], row["end_page"], row["page_range_error"]) == (start, end, None)


@pytest.mark.parametrize("text", ["3x5", "abc", "-3", "5-3", "0", "3-", "1-2-3", "99999999999"])
def test_bad_page_ranges_are_an_error_of_the_row(spark, text):
    row = one(spark, page_range(F.col("p")), p=text)
    assert (row["start_page"], row["end_page"]) == (None, None)
    assert row["page_range_error"] == f"Invalid page range: {text}"


@pytest.mark.parametrize("start, end, out", [
    (1, 2, "b|c"), (0, 0, "a"), (None, None, "a|b|c|d"), (2, 99, "c|d"), (9, 10, "")])
def test_page_slices(spark, start, end, out):
    frame = spark.createDataFrame([("a|b|c|d", start, end)], "t string, s int, e int")
    column = slice_pages(F.col("t"), F.col("s"), F.col("e"), "|")
    assert frame.select(column).first()[0] == out


def test_page_rows(spark):
    frame = spark.range(10).withColumn("r", page_range(F.lit("3-5")))
    kept = frame.where(page_selected(F.col("id"), F.col("r.start_page"), F.col("r.end_page")))
    assert [row["id"] for row in kept.collect()] == [2, 3, 4]
