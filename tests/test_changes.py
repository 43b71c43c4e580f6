"""Streams of files that are new or were changed in place."""

import os

import pytest
from pyspark.sql import functions as F

from helpers import values
from quire.operators.convert import convert_text
from quire.options import Options
from quire.plans.run import Workspace
from quire.sources import inbox
from quire.streaming import changes
from quire.streaming.changes import ChangedFilesReader, changed_documents
from quire.streaming.ingest import start_workspace


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "inbox"
    (root / "sub").mkdir(parents=True)
    for name in ("a.txt", "b.txt", "sub/c.txt", "_hidden.txt"):
        put(root, name, b"first " + name.encode(), 1_700_000_000)
    return root


def put(root, name, data, when):
    (root / name).write_bytes(data)
    os.utime(root / name, (when, when))


def reader_of(folder, tmp_path, **more):
    return ChangedFilesReader({"path": str(folder), "state": str(tmp_path / "state"), **more})


def names(reader, start, end):
    batches = [b for p in reader.partitions(start, end) for b in reader.read(p)]
    return sorted(p.rpartition("/")[2] for b in batches for p in b.column("path").to_pylist())


def run(spark, folder, tmp_path, save, **more):
    docs = changed_documents(spark, str(folder), str(tmp_path / "state"), **more)
    query = docs.writeStream.foreachBatch(save).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_offsets_are_differences_of_the_folder(folder, tmp_path):
    reader = reader_of(folder, tmp_path)
    start, first = reader.initialOffset(), reader.latestOffset()
    assert names(reader, start, first) == ["a.txt", "b.txt", "c.txt"]
    assert reader.latestOffset() == first  # nothing happened

    put(folder, "a.txt", b"other text", 1_700_000_000)  # length
    put(folder, "b.txt", b"first b.txt", 1_700_000_060)  # time
    put(folder, "new.txt", b"n", 1_700_000_000)
    os.remove(folder / "sub" / "c.txt")
    again = reader_of(folder, tmp_path)  # a stream that starts anew
    second = again.latestOffset()
    assert names(again, first, second) == ["a.txt", "b.txt", "new.txt"]
    assert names(again, start, first) == ["a.txt", "b.txt", "c.txt"]  # a batch repeated

    put(folder, "sub/c.txt", b"first sub/c.txt", 1_700_000_000)  # back as it was
    assert names(again, second, again.latestOffset()) == ["c.txt"]


def test_differences_are_merged_once_no_batch_needs_them(folder, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "KEPT_DIFFERENCES", 3)
    reader = reader_of(folder, tmp_path, files_per_batch=1)
    at = reader.latestOffset()
    assert at == {"difference": 3}
    for i in range(8):
        put(folder, "a.txt", b"a" * (50 + i), 1_700_000_000)
        before, at = at, reader.latestOffset()
        assert names(reader, before, at) == ["a.txt"]
        reader.commit(at)
    assert len(os.listdir(tmp_path / "state")) <= 3
    assert reader_of(folder, tmp_path).latestOffset() == at
    os.remove(folder / "b.txt")
    assert names(reader, at, reader.latestOffset()) == []


def test_an_empty_or_missing_folder(tmp_path):
    reader = reader_of(tmp_path / "none", tmp_path)
    assert reader.latestOffset() == reader.initialOffset()
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []


def test_paths_lengths_and_times_are_those_of_a_scan(spark, folder, tmp_path):
    got = []
    run(spark, folder, tmp_path, lambda batch, i: got.extend(
        values(batch, "path", "length", "modificationTime")))
    scanned = inbox.scan(spark, str(folder))
    assert sorted(got) == values(scanned, "path", "length", "modificationTime")


def test_a_batch_that_failed_is_delivered_again_and_only_once(spark, folder, tmp_path):
    got = []

    def fail(batch, i):
        batch.collect()
        raise ValueError("killed")

    def save(batch, i):
        got.extend(row["path"].rpartition("/")[2] for row in batch.collect())

    with pytest.raises(Exception, match="killed"):
        run(spark, folder, tmp_path, fail)
    put(folder, "late.txt", b"late", 1_700_000_000)
    run(spark, folder, tmp_path, save)
    run(spark, folder, tmp_path, save)
    assert sorted(got) == ["a.txt", "b.txt", "c.txt", "late.txt"]


def test_a_workspace_converts_changed_files_from_a_stream(spark, folder, tmp_path):
    space = Workspace(
        spark, str(tmp_path / "out"), Options(supported=(".txt",)), {".txt": convert_text})

    def ingest():
        docs = changed_documents(spark, str(folder), str(tmp_path / "state"))
        start_workspace(docs, space, F.lit("2024-01-01"), str(tmp_path / "cp")).awaitTermination()

    ingest()
    assert space.status().first()["success"] == 3
    put(folder, "a.txt", b"changed in place", 1_700_000_050)
    put(folder, "new.txt", b"new", 1_700_000_050)
    ingest()
    found = values(space.ledger.read(), "source_filename", "seq")
    seqs = sorted(name for name, seq in found if seq > 1)
    assert seqs == ["a.txt", "new.txt"] and len(found) == 5
    plan = space.plan(inbox.scan(spark, str(folder)), by_path=True)
    assert {row["action"] for row in plan.collect()} == {"skip"}
