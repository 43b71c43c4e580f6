"""Checks of a ledger against the outputs that are really there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.links import local_image_refs
from quire.operators.skew import HOT_ROWS, cut_lineage, lookup_join

ERROR, WARNING = "error", "warning"


def _finding(severity: str, kind: str, path: Column, ref: Column) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(kind).alias("kind"),
            path.alias("path"), ref.alias("ref")]


def _once(findings: DataFrame) -> DataFrame:
    return findings.withColumn("times", F.lit(1).cast("long"))


def _has_output(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.coalesce(F.col("output_md"), F.lit("")) != "")


def missing_outputs(
    ledger: DataFrame, markdown: DataFrame, attachment_groups: DataFrame,
    keys: Sequence[str] = ("output_md",), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Records without their outputs, as findings.

    ``markdown(keys)`` and ``attachment_groups(output_attachments)`` list what is
    there. A record without an output name is a warning and is not checked further; an
    absent Markdown text is an error; an absent attachment group is a warning, looked at
    only where the Markdown exists.
    """
    columns = dict.fromkeys(
        ["source_path", "file_hash", "output_md", "output_attachments", *keys])
    records = ledger.select(*columns)
    unnamed = records.where(F.coalesce(F.col("output_md"), F.lit("")) == "").select(
        *_finding(WARNING, "no_output", F.col("file_hash"), F.lit(None).cast("string")))
    named = _has_output(records)
    there = markdown.select(*keys).distinct().withColumn("_there", F.lit(True))
    checked = lookup_join(named, there, list(keys), "left", "source_path", hot_rows)
    no_markdown = checked.where(F.col("_there").isNull()).select(
        *_finding(ERROR, "missing_markdown", F.col("output_md"), F.col("output_md")))
    grouped = checked.where(
        F.col("_there") & (F.coalesce("output_attachments", F.lit("")) != ""))
    groups = attachment_groups.select("output_attachments").distinct()
    # copies of one content share a group, which may be a large part of all records
    no_attachments = lookup_join(
        grouped, groups, ["output_attachments"], "left_anti", "source_path", hot_rows
    ).select(*_finding(
        WARNING, "missing_attachments", F.col("output_md"), F.col("output_attachments")))
    return _once(unnamed.unionByName(no_markdown).unionByName(no_attachments))


def image_links(texts: DataFrame, *keys: str) -> DataFrame:
    """One row per local image link of ``texts(keys, md)``; external ones dropped.

    The rows are short: do this before any join, so that no join moves a text.
    """
    return texts.select(*keys, F.explode(local_image_refs(F.col("md"))).alias("ref"))


def dangling_refs(
    links: DataFrame, attachment_files: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Links (see ``image_links``) whose target is not among ``attachment_files(ref)``.

    Any single target, such as a logo, may be in a large part of the texts.
    """
    key = next(c for c in links.columns if c != "ref")
    there = attachment_files.select("ref").distinct()
    return lookup_join(links, there, ["ref"], "left_anti", key, hot_rows)


def ref_findings(missing: DataFrame) -> DataFrame:
    """Findings for ``missing(output_md, ref)``; a link used several times is one finding
    with that number."""
    counted = missing.groupBy("output_md", "ref").agg(F.count(F.lit(1)).alias("times"))
    return counted.select(
        *_finding(WARNING, "dangling_ref", F.col("output_md"), F.col("ref")), "times")


def validate(
    ledger: DataFrame, markdown: DataFrame, links: DataFrame, attachment_groups: DataFrame,
    attachment_files: DataFrame, keys: Sequence[str] = ("output_md",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All findings: ``markdown(keys)`` lists the texts and ``links(keys, ref)`` their image
    links. A text's missing links count for every record that names it, as often as the text
    uses them; texts that no record names are not looked at.

    Equal links of a text are one row with a number before any join, and both joins spread
    hot keys.
    """
    keys = list(keys)
    counted = links.groupBy(*keys, "ref").agg(F.count(F.lit(1)).alias("times"))
    missing = cut_lineage(dangling_refs(counted, attachment_files, hot_rows), "dangling")
    named = _has_output(ledger).select(*dict.fromkeys(["output_md", *keys]))
    records = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("records"))
    if "output_md" in keys:  # the text is named, by however many records
        records = records.withColumn("records", F.lit(1))
    listed = lookup_join(missing, records, keys, "inner", "ref", hot_rows)
    refs = listed.groupBy("output_md", "ref").agg(
        F.sum(F.col("times") * F.col("records")).alias("times")).select(
        *_finding(WARNING, "dangling_ref", F.col("output_md"), F.col("ref")), "times")
    outputs = missing_outputs(ledger, markdown, attachment_groups, keys, hot_rows)
    return outputs.unionByName(refs)


def summary(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: files_checked, errors, warnings, is_valid. An empty ledger is a warning."""
    counted = findings.agg(
        F.coalesce(F.sum(F.when(F.col("severity") == ERROR, F.col("times"))), F.lit(0))
        .alias("errors"),
        F.coalesce(F.sum(F.when(F.col("severity") == WARNING, F.col("times"))), F.lit(0))
        .alias("warnings"),
    ).withColumn("files_checked", F.lit(0).cast("long"))
    checked = ledger.agg(F.count(F.lit(1)).alias("files_checked")).select(
        F.lit(0).cast("long").alias("errors"),
        F.when(F.col("files_checked") == 0, 1).otherwise(0).cast("long").alias("warnings"),
        "files_checked")
    total = counted.unionByName(checked).agg(
        F.sum("files_checked").alias("files_checked"),
        F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings"))
    return total.withColumn("is_valid", F.col("errors") == 0)
