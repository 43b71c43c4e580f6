"""Ledger rows, incremental classification, plans, reports and storage."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from helpers import values
from quire.operators import ledger as ledgers
from quire.options import Options
from quire.schemas import LEDGER
from quire.sources.ledger_store import LedgerStore
from quire.sources.manifest import read_manifest, write_manifest

STAMP = datetime.datetime(2024, 1, 1)


def record(path, file_hash, seq=1, status="success", size=10, **more):
    name = path.rsplit("/", 1)[-1]
    row = {
        "source_path": path, "source_filename": name, "source_size": size,
        "file_hash": file_hash, "output_md": f"{name}.md", "output_attachments": "attachments/x",
        "format": ".txt", "converted_at": STAMP, "status": status,
        "error": None if status == "success" else "boom", "seq": seq}
    return tuple((row | more)[field] for field in LEDGER.fieldNames())


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), LEDGER)


def docs(spark, *rows):
    schema = "path string, source_filename string, length long, format string, file_hash string"
    full = [(path, path.rsplit("/", 1)[-1], size, "." + path.rsplit(".", 1)[-1].lower(), digest)
            for path, digest, size in rows]
    return spark.createDataFrame(full, schema)


def states(spark, found, known, options=Options(), **more):
    return dict(values(ledgers.classify(found, known, options, **more), "path", "state"))


def test_new_unchanged_modified_moved(spark):
    known = ledger(spark, record("/a.txt", "h1"), record("/b.txt", "h2"), record("/c.txt", "h3"))
    found = docs(spark, ("/a.txt", "h1", 10), ("/b.txt", "h9", 10), ("/new/c.txt", "h3", 10),
                 ("/new/d.txt", "h3", 10), ("/new/sub/c.txt", "h3", 11), ("/e.txt", None, 1))
    assert states(spark, found, known) == {
        "/a.txt": "unchanged", "/b.txt": "modified", "/new/c.txt": "moved",
        "/new/d.txt": "new", "/new/sub/c.txt": "new", "/e.txt": "new"}


def test_the_last_record_of_a_path_decides(spark):
    known = ledger(spark, record("/a.txt", "old", 1), record("/a.txt", "new", 2))
    assert states(spark, docs(spark, ("/a.txt", "new", 10)), known) == {"/a.txt": "unchanged"}
    assert states(spark, docs(spark, ("/a.txt", "old", 10)), known) == {"/a.txt": "modified"}


def test_failed_documents_are_left_unless_wanted(spark):
    known = ledger(spark, record("/a.txt", "h", status="failed"))
    found = docs(spark, ("/a.txt", "h", 10))
    assert states(spark, found, known) == {"/a.txt": "unchanged"}
    assert states(spark, found, known, Options(retry_failed=True)) == {"/a.txt": "retry"}


def test_hot_copies_give_the_same_states(spark):
    known = ledger(spark, record("/old/x.txt", "h"), record("/q/y.txt", "k"))
    rows = [(f"/n{i}/x.txt", "h", 10) for i in range(300)] + [("/z/y.txt", "k", 10), ("/w", "v", 1)]
    assert states(spark, docs(spark, *rows), known) == states(
        spark, docs(spark, *rows), known, hot_rows=50)


def test_empty_ledger_makes_everything_new(spark):
    found = docs(spark, ("/a.txt", "h", 1), ("/b.odt", "k", 1))
    plan = ledgers.build_plan(found, ledgers.empty_ledger(spark), Options(supported=(".txt",)))
    assert values(plan, "path", "action", "reason") == [
        ("/a.txt", "process", "New"), ("/b.odt", "unsupported", "Unsupported format: .odt")]


def test_plan_pending_and_force(spark):
    known = ledger(spark, record("/a.txt", "h1"), record("/b.txt", "h2"))
    found = docs(spark, ("/a.txt", "h1", 10), ("/b.txt", "x", 10), ("/c.txt", "y", 10), ("/d.odt", "z", 1))
    options = Options(supported=(".txt",))
    plan = ledgers.build_plan(found, known, options)
    assert values(plan, "path", "action", "reason") == [
        ("/a.txt", "skip", "Already converted"),
        ("/b.txt", "process", "Modified (re-conversion needed)"),
        ("/c.txt", "process", "New"),
        ("/d.odt", "unsupported", "Unsupported format: .odt")]
    assert values(ledgers.pending(found, plan), "path") == [("/b.txt",), ("/c.txt",)]
    forced = ledgers.build_plan(found, known, Options(supported=(".txt",), force=True))
    assert values(ledgers.pending(found, forced), "path") == [("/a.txt",), ("/b.txt",), ("/c.txt",)]


def test_upsert_keeps_two_paths_of_one_content(spark):
    old = ledger(spark, record("/a", "h"), record("/b", "h"), record("/c", "k", status="failed"))
    merged = ledgers.upsert(old, ledger(spark, record("/c", "k", 2), record("/a", "h2", 2)))
    assert values(merged, "source_path", "file_hash", "status") == [
        ("/a", "h", "success"), ("/a", "h2", "success"), ("/b", "h", "success"),
        ("/c", "k", "success")]


def test_status_counts_everything_else_as_failed(spark):
    rows = ledger(spark, record("/a", "1"), record("/b", "2", status="failed"),
                  record("/c", "3", status="pending"), record("/d", "4", status=None))
    assert ledgers.status(rows).first().asDict() == {"total": 4, "success": 1, "failed": 3}
    assert values(ledgers.converted_list(rows), "file") == [("a",)]
    assert values(ledgers.failed_list(rows), "file") == [("b",), ("c",), ("d",)]


def test_batch_stats_and_json(spark):
    rows = spark.createDataFrame([("success",), ("skipped",), ("failed",), ("success",)], "status string")
    report = ledgers.batch_stats(rows)
    assert report.first().asDict() == {"scanned": 4, "processed": 2, "skipped": 1, "failed": 1}
    assert json.loads(ledgers.as_json(report).first()["report"])["processed"] == 2
    empty = ledgers.batch_stats(rows.where("false")).first().asDict()
    assert empty == {"scanned": 0, "processed": 0, "skipped": 0, "failed": 0}


def test_records_of_results(spark):
    rows = spark.createDataFrame(
        [("/in/a.txt", "a.txt", 5, "h" * 64, ".txt", "success", None, "a.md"),
         ("/in/b.txt", "b.txt", 6, "k" * 64, ".txt", "failed", "boom", None),
         ("/in/c.odt", "c.odt", 6, "l" * 64, ".odt", "skipped", "Unsupported", None)],
        "path string, source_filename string, length long, file_hash string, format string, "
        "status string, error string, md_filename string")
    built = ledgers.build_records(rows, F.lit("2024-01-01"), 7)
    assert built.schema.fieldNames() == LEDGER.fieldNames()
    assert values(built, "source_path", "output_md", "output_attachments", "error", "seq") == [
        ("/in/a.txt", "a.md", "attachments/hhhhhhhh", None, 7), ("/in/b.txt", "", "", "boom", 7)]


# -- storage -----------------------------------------------------------------------


def test_manifest_of_a_single_machine(spark, tmp_path):
    entry = {
        "source_path": "/in/é.pdf", "source_filename": "é.pdf", "output_md": "é.md",
        "output_attachments": "attachments/12345678", "format": ".pdf",
        "converted_at": "2024-05-06T07:08:09.123456+00:00", "status": "success", "error": None}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"version": "1.0", "files": {"a" * 64: entry}}, indent=2), "utf-8")
    row = read_manifest(spark, str(path)).first()
    assert row["file_hash"] == "a" * 64 and row["source_filename"] == "é.pdf"
    assert row["converted_at"] == datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    assert row["source_size"] is None


def test_missing_manifest_is_empty_and_a_broken_one_fails(spark, tmp_path):
    assert read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text('{"version": "1.0", "files": {')
    with pytest.raises(Exception):
        read_manifest(spark, str(tmp_path / "bad.json")).collect()


def test_manifest_round_trip(spark, tmp_path):
    rows = ledger(spark, record("/a", "h"), record("/b", "h"), record("/c", "k", status="failed"))
    write_manifest(rows, str(tmp_path / "m"))
    back = read_manifest(spark, str(tmp_path / "m"), one_object_per_file=False, seq=1)
    assert values(back, *LEDGER.fieldNames()) == values(rows, *LEDGER.fieldNames())


def test_store_appends_replaces_and_compacts(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    assert store.read().count() == 0 and store.next_version() == 1
    assert store.append(ledger(spark, record("/a", "h"), record("/b", "k"))) == 1
    assert store.append(ledger(spark, record("/a", "h", status="failed")), name="batch 0") == 2
    assert values(store.read(), "source_path", "status", "seq") == [
        ("/a", "failed", 2), ("/b", "success", 1)]
    again = store.append(ledger(spark, record("/a", "h")), name="batch 0")
    assert again == 2
    assert values(store.read(), "source_path", "status") == [("/a", "success"), ("/b", "success")]
    assert store.compact() == 3
    assert values(store.read(), "source_path", "seq") == [("/a", 2), ("/b", 1)]
    assert store.append(ledger(spark, record("/b", "k", status="failed"))) == 4
    assert values(store.read(), "source_path", "status") == [("/a", "success"), ("/b", "failed")]


def test_a_named_run_that_a_snapshot_holds_can_be_repeated_with_other_rows(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    store.append(ledger(spark, record("/a", "h", status="failed")), name="day 1")
    store.compact()
    store.append(ledger(spark, record("/a", "h"), record("/b", "k")), name="day 1")
    assert values(store.read(), "source_path", "status") == [("/a", "success"), ("/b", "success")]


def test_runs_are_merged_by_themselves(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"), most_runs=3)
    for i in range(9):
        store.append(ledger(spark, record(f"/{i}", "h")))
    assert len(store._live()) <= 4
    assert values(store.read(), "source_path") == [(f"/{i}",) for i in range(9)]
    kept = len(list((tmp_path / "ledger" / "runs").iterdir()))
    assert kept < 9  # what the last snapshot but one covers is gone


def test_a_run_without_its_commit_is_not_seen(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "ledger"))
    store.append(ledger(spark, record("/a", "h")))
    ledger(spark, record("/b", "k")).write.parquet(f"{store.root}/runs/v2")
    assert values(store.read(), "source_path") == [("/a",)]
    assert store.append(ledger(spark, record("/c", "m"))) == 2
    assert values(store.read(), "source_path") == [("/a",), ("/c",)]
