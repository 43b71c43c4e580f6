"""The ledger of what was converted, and what it says about new documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.names import is_supported, unsupported_reason
from quire.operators.convert import attachments_path
from quire.operators.skew import HOT_ROWS, cut_lineage, lookup_join
from quire.options import Options
from quire.schemas import LEDGER
from quire.sources import keyed_store

KEY = ["source_path", "file_hash"]
# So many documents of unknown path, at a few hundred bytes each, may be sent to every task.
FEW = 100_000

# Reasons given in a plan.
ALREADY_CONVERTED = "Already converted"
MODIFIED = "Modified (re-conversion needed)"
NEW = "New"
MOVED = "Already converted under another path"
RETRY = "Failed before"


def build_records(
    results: DataFrame, run_at: Column, seq: int, options: Options = Options()
) -> DataFrame:
    """Ledger rows for ``results(path, source_filename, length, file_hash, format, status,
    error, md_filename)``. ``run_at`` is passed in, so a repeated run writes the same rows.
    """
    done = F.col("status") == "success"
    return results.where(F.col("status") != "skipped").select(
        F.col("path").alias("source_path"),
        "source_filename",
        F.col("length").alias("source_size"),
        "file_hash",
        F.when(done, F.col("md_filename")).otherwise("").alias("output_md"),
        F.when(done, attachments_path(F.col("file_hash"), options)).otherwise("")
        .alias("output_attachments"),
        "format",
        run_at.cast("timestamp").alias("converted_at"),
        "status",
        "error",
        F.lit(seq).cast("long").alias("seq"),
    )


def last_per(ledger: DataFrame, *keys: str) -> DataFrame:
    """The row with the highest ``seq`` per key, ties by the rest of the ledger's key."""
    return keyed_store.last_per(ledger, keys, [c for c in KEY if c not in keys])


def upsert(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Last write wins per (source_path, file_hash)."""
    return last_per(ledger.unionByName(records), *KEY)


def classify(
    docs: DataFrame, ledger: DataFrame, options: Options = Options(), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds ``state`` to ``docs(path, source_filename, length, file_hash, …)``.

    unchanged: the latest record of this path has the same hash; modified: another one;
    moved: the path is unknown, but name, size and hash are those of a record; else new.
    With ``retry_failed``, an unchanged document that failed before is ``retry``.

    Documents meet the ledger by path first; a stored ledger is bucketed by path and is not
    moved for that. Only those whose path is unknown, which are few in a usual run, are looked
    up by name, size and hash: up to ``FEW`` of them go to the tasks that read the ledger,
    more are met by shuffling both sides.
    """
    by_path = last_per(ledger, "source_path").select(
        F.col("source_path").alias("path"),
        F.col("file_hash").alias("_hash"),
        F.col("status").alias("_status"),
        F.lit(True).alias("_known"),
    )
    failed = F.lit(options.retry_failed) & (F.col("_status") != "success")
    state = (
        F.when((F.col("_hash") == F.col("file_hash")) & failed, "retry")
        .when(F.col("_hash") == F.col("file_hash"), "unchanged")
        .otherwise("modified")
    )
    found = cut_lineage(docs.join(by_path, "path", "left"), "by-path")
    known = found.where("_known").select(*docs.columns, state.alias("state"))
    fresh = found.where("_known is null").select(*docs.columns)
    looked_up = _looked_up(fresh, ledger, hot_rows)
    moved = F.when(F.col("_moved"), "moved").otherwise("new")
    return known.unionByName(looked_up.select(*docs.columns, moved.alias("state")))


def _looked_up(fresh: DataFrame, ledger: DataFrame, hot_rows: int) -> DataFrame:
    """``_moved`` is true for documents whose name, size and hash are those of a record."""
    number = fresh.count()
    if not number:
        return fresh.withColumn("_moved", F.lit(None).cast("boolean"))
    sizes = ["source_filename", "length", "file_hash"]
    seen = ledger.where(F.col("source_size").isNotNull()).select(
        "source_filename", F.col("source_size").alias("length"), "file_hash")
    if number <= FEW:
        seen = seen.join(F.broadcast(fresh.select(*sizes).distinct()), sizes, "left_semi")
    return lookup_join(
        fresh, seen.distinct().withColumn("_moved", F.lit(True)), sizes, "left", "path", hot_rows)


def build_plan(
    docs: DataFrame, ledger: DataFrame, options: Options = Options(), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """What a run would do: ``action`` is process, skip or unsupported, with a reason."""
    fits = is_supported(F.col("format"), options.supported)
    state = F.col("state")
    done = state.isin("unchanged", "moved") & ~F.lit(options.force)
    action = F.when(~fits, "unsupported").when(done, "skip").otherwise("process")
    reason = (
        F.when(~fits, unsupported_reason(F.col("path")))
        .when(state == "unchanged", ALREADY_CONVERTED)
        .when(state == "moved", MOVED)
        .when(state == "modified", MODIFIED)
        .when(state == "retry", RETRY)
        .otherwise(NEW)
    )
    states = classify(docs, ledger, options, hot_rows)
    return states.withColumns({"action": action, "reason": reason})


def pending(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents a plan does not leave out, with all their columns. Where the plan has
    those itself, as ``build_plan`` does, that is a filter."""
    todo = plan.where(F.col("action") == "process")
    if set(docs.columns) <= set(plan.columns):
        return todo.select(*docs.columns)
    return docs.join(todo.select("path"), "path", "left_semi")


def status(ledger: DataFrame) -> DataFrame:
    """One row: total, success and failed (whatever is not a success)."""
    good = F.coalesce(F.col("status") == "success", F.lit(False))
    return ledger.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("success"),
        F.count_if(~good).alias("failed"),
    )


def converted_list(ledger: DataFrame) -> DataFrame:
    rows = ledger.where(F.col("status") == "success")
    return rows.select(F.col("source_filename").alias("file"), "format", "converted_at")


def failed_list(ledger: DataFrame) -> DataFrame:
    rows = ledger.where(~F.coalesce(F.col("status") == "success", F.lit(False)))
    return rows.select(F.col("source_filename").alias("file"), "error")


def batch_stats(results: DataFrame) -> DataFrame:
    """One row: scanned, processed, skipped, failed."""
    return results.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("status") == "success").alias("processed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def as_json(report: DataFrame) -> DataFrame:
    """A report as one JSON text per row."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)
