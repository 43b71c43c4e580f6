"""What a stream of ledger records changes, known from state and not from the ledger."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quire.operators.ledger import KEY
from quire.schemas import LEDGER
from quire.sources.ledger_store import LedgerStore

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = T.StructType([*LEDGER.fields, T.StructField("change", T.StringType())])
NAMES = LEDGER.fieldNames()
# Paths of the state with one key; part of what a checkpoint holds, so it must not change.
BUCKETS = 4096


class _LastRecords(StatefulProcessor):
    """Of the paths of a bucket, the content and the digest of each one's last record."""

    def init(self, handle) -> None:
        self.last = handle.getMapState("last", "path string", "file_hash string, digest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # a row per path and content, however many rows a path has
        newest: dict[str, dict[str, Row]] = {}
        for row in rows:
            of_path = newest.setdefault(row["path"], {})
            known = of_path.get(row["file_hash"])
            if known is None or (row["seq"], row["digest"]) > (known["seq"], known["digest"]):
                of_path[row["file_hash"]] = row
        # each call is a round trip to the executor: one to read, one to write what changed
        for path, of_path in newest.items():
            found = self.last.getValue((path,))
            before = None if found is None else tuple(found)
            last = before
            for row in sorted(of_path.values(), key=lambda r: (r["seq"], r["file_hash"] or "")):
                said = (row["file_hash"] or "", row["digest"])
                if last is None:
                    change = "new"
                elif said == last:
                    change = "unchanged"
                else:
                    change = "modified"
                last = said
                yield Row(**{name: row[name] for name in NAMES}, change=change)
            if last != before:
                self.last.updateValue((path,), last)

    def close(self) -> None:
        pass


def record_changes(records: DataFrame) -> DataFrame:
    """A stream of ledger records with ``change``: ``new`` for the first of a path,
    ``unchanged`` where the path's last record said the same, else ``modified``.

    The state per path lives in a state store beside the checkpoint and moves with it, so no
    batch reads the ledger. Paths are dealt to ``BUCKETS`` keys, as a key costs more calls to
    the store than a path; a task holds a batch's rows of one bucket. Of several records of one content in a batch only the one with
    the highest ``seq`` counts. The time and number of a run are not part of what a record
    says. The session needs the store that ``start_ledger_upsert`` sets.
    """
    said = [name for name in LEDGER.fieldNames() if name not in ("converted_at", "seq")]
    digested = records.select(
        *LEDGER.fieldNames(), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
                                           for c in said]).alias("digest"))
    path = F.coalesce(KEY[0], F.lit(""))
    bucket = F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")
    return digested.withColumns({"path": path, "bucket": bucket}).groupBy(
        "bucket").transformWithState(_LastRecords(), CHANGE, "Update", "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The provider that keeps state outside the heap; as it was afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def start_ledger_upsert(
    records: DataFrame, store: LedgerStore, checkpoint: str
) -> StreamingQuery:
    """Records that say something new become runs of the ledger; the others, such as those of
    sources that repeat themselves, cost the state lookup only. A batch that is repeated
    after a failure starts from the state before it and replaces its own run."""

    def save(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        news = batch.where("change <> 'unchanged'").drop("change").persist()
        try:
            if not news.isEmpty():
                store.append(news, name=f"{stream}#{batch_id}")
        finally:
            news.unpersist()

    with state_store(records.sparkSession):
        return (
            record_changes(records).writeStream.foreachBatch(save).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
