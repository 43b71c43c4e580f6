"""Ledger records of a stream against the batch upsert."""

import pytest
from pyspark.sql import functions as F

from helpers import values
from quire.operators import ledger as ledgers
from quire.schemas import LEDGER
from quire.sources.ledger_store import LedgerStore
from quire.streaming import upsert


def record(path, file_hash, seq, status="success"):
    return (path, path.rpartition("/")[2], 3, file_hash, "", "", ".txt", None, status, None, seq)


BATCHES = [
    [record("/a", "h", 1), record("/b", "k", 1), record("/b", "k", 1)],
    [record("/a", "h", 2), record("/b", "m", 2), record("/c", "h", 2, "failed")],   # /a says the same
    [record("/b", "k", 3), record("/c", "h", 3), record("/c", "h", 2, "failed")],
]


def test_batches_with_repeats_and_a_restart_equal_the_batch_upsert(spark, tmp_path):
    store, source = LedgerStore(spark, str(tmp_path / "ledger"), buckets=2), str(tmp_path / "in")
    everything = spark.createDataFrame([], LEDGER)
    said, real = [], store.append

    def append(rows, name=None, version=None):
        said.append(sorted((r["source_path"], r["file_hash"]) for r in rows.collect()))
        if len(said) == 2:
            raise ValueError("killed")  # the second batch fails once
        return real(rows, name, version)

    store.append = append
    for rows in BATCHES:
        batch = spark.createDataFrame(rows, LEDGER)
        batch.coalesce(1).write.mode("append").parquet(source)
        everything = ledgers.upsert(everything, batch)
        for attempt in range(2):
            stream = spark.readStream.schema(LEDGER).parquet(source)
            query = upsert.start_ledger_upsert(stream, store, str(tmp_path / "cp"))
            try:
                query.awaitTermination()
                break
            except Exception as problem:
                assert "killed" in str(problem) and attempt == 0
    columns = ["source_path", "file_hash", "status"]
    assert values(store.read(), *columns) == values(everything, *columns)
    assert said == [
        [("/a", "h"), ("/b", "k")],
        [("/b", "m"), ("/c", "h")], [("/b", "m"), ("/c", "h")],  # the same rows again
        [("/b", "k"), ("/c", "h")]]
    assert spark.conf.get(upsert.PROVIDER, None) != upsert.ROCKS


def test_changes_of_a_path(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [record("/x", "1", 1), record("/x", "2", 2), record("/x", "2", 2), record("/y", None, 1)]
    spark.createDataFrame(rows, LEDGER).write.parquet(source)
    found = []
    with upsert.state_store(spark):
        upsert.record_changes(spark.readStream.schema(LEDGER).parquet(source)).writeStream.foreachBatch(
            lambda batch, i: found.extend(values(batch, "source_path", "file_hash", "change"))
        ).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start().awaitTermination()
    assert sorted(found, key=repr) == sorted(
        [("/x", "1", "new"), ("/x", "2", "modified"), ("/y", None, "new")], key=repr)


class CountedState:
    """A map state that counts how often it is asked."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getMapState(self, name, key_schema, value_schema):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value


def test_a_path_costs_one_read_and_one_write_of_what_changed():
    state, processor = CountedState(), upsert._LastRecords()
    processor.init(state)

    def changes(*records):
        rows = [dict(zip(LEDGER.fieldNames(), record)) | {"path": record[0], "digest": digest}
                for record, digest in records]
        before = state.calls
        found = [row[-1] for row in processor.handleInputRows((7,), iter(rows), None)]
        return found, state.calls - before

    assert changes((record("/a", "h", 1), 5), (record("/b", "h", 1), 5)) == (["new"] * 2, 4)
    assert changes((record("/a", "h", 2), 5)) == (["unchanged"], 1)
    assert changes((record("/a", "k", 3), 6), (record("/a", "h", 4), 5)) == (["modified"] * 2, 1)
    assert changes((record("/a", "k", 5), 6), (record("/b", "h", 5), 5)) == (
        ["modified", "unchanged"], 3)
    assert changes((record("/a", None, 6), 7), (record("/a", "", 6), 7)) == (
        ["modified", "unchanged"], 2)
