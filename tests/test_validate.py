"""Findings about ledger, texts and attachments."""

import pytest
from pyspark.sql import functions as F

from helpers import values
from quire.operators import validate as checks

RECORDS = "source_path string, file_hash string, output_md string, output_attachments string"


def inputs(spark):
    ledger = spark.createDataFrame([
        ("/1", "h1", "a.md", "attachments/h1"), ("/2", "h2", "gone.md", "attachments/h2"),
        ("/3", "h3", "", ""), ("/4", "h4", None, None), ("/5", "h5", "e.md", "attachments/none"),
        ("/6", "h6", "f.md", "")], RECORDS)
    texts = spark.createDataFrame([
        ("a.md", "![x](attachments/h1/x.png) ![y](attachments/h1/y.png) ![z](https://h/z.png)"),
        ("e.md", "no links"), ("f.md", "![q](images/q.png)"), ("unknown.md", "![q](nowhere.png)")],
        "output_md string, md string")
    groups = spark.createDataFrame([("attachments/h1",)], "output_attachments string")
    there = spark.createDataFrame([("attachments/h1/x.png",)], "ref string")
    return ledger, texts, groups, there


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_findings(spark, hot_rows):
    ledger, texts, groups, there = inputs(spark)
    links = checks.image_links(texts, "output_md")
    found = checks.validate(ledger, texts, links, groups, there, hot_rows=hot_rows)
    assert values(found, "severity", "kind", "path", "ref") == sorted([
        ("error", "missing_markdown", "gone.md", "gone.md"),
        ("warning", "dangling_ref", "a.md", "attachments/h1/y.png"),
        ("warning", "dangling_ref", "f.md", "images/q.png"),
        ("warning", "missing_attachments", "e.md", "attachments/none"),
        ("warning", "no_output", "h3", None), ("warning", "no_output", "h4", None)], key=repr)
    assert checks.summary(found, ledger).first().asDict() == {
        "files_checked": 6, "errors": 1, "warnings": 5, "is_valid": False}


def test_links_are_taken_out_before_any_join(spark):
    _, texts, _, there = inputs(spark)
    found = checks.dangling_refs(checks.image_links(texts, "output_md"), there)
    assert found.columns == ["ref", "output_md"]


def test_an_empty_ledger_is_a_warning(spark):
    ledger = spark.createDataFrame([], RECORDS)
    none = spark.createDataFrame([], "severity string, kind string, path string, ref string, times long")
    assert checks.summary(none, ledger).first().asDict() == {
        "files_checked": 0, "errors": 0, "warnings": 1, "is_valid": True}


def test_a_text_named_by_many_records_is_reported_per_record_only_if_missing(spark):
    ledger = spark.range(50).select(
        F.concat(F.lit("/"), F.col("id").cast("string")).alias("source_path"),
        F.lit("h").alias("file_hash"), F.lit("same.md").alias("output_md"),
        F.lit("attachments/h").alias("output_attachments"))
    texts = spark.createDataFrame([("same.md",)], "output_md string")
    groups = spark.createDataFrame([], "output_attachments string")
    found = checks.missing_outputs(ledger, texts, groups, hot_rows=10)
    assert values(found, "kind") == [("missing_attachments",)] * 50


def test_a_link_used_twice_counts_twice_for_every_record_of_its_content(spark):
    ledger = spark.createDataFrame([
        ("/1", "h", "a.md", ""), ("/2", "h", "b.md", ""), ("/3", "gone", "a.md", "")], RECORDS)
    links = spark.createDataFrame([("h", "x.png"), ("h", "x.png")], "file_hash string, ref string")
    texts = spark.createDataFrame([("h",)], "file_hash string")
    nothing = spark.createDataFrame([], "output_attachments string")
    found = checks.validate(ledger, texts, links, nothing, spark.createDataFrame([], "ref string"),
                            keys=["file_hash"])
    assert values(found, "kind", "path", "times") == [
        ("dangling_ref", "a.md", 2), ("dangling_ref", "b.md", 2), ("missing_markdown", "a.md", 1)]
    summary = checks.summary(found, ledger).first()
    assert (summary["errors"], summary["warnings"], summary["is_valid"]) == (1, 4, False)
