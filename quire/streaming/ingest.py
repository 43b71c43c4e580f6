"""Streams: convert documents as they arrive, and keep the ledger as they are done."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.convert import Converter, convert
from quire.options import Options
from quire.plans.run import Workspace
from quire.sources.inbox import with_format
from quire.sources.ledger_store import LedgerStore


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """New files of a folder. A file that was changed in place is not seen again: run the
    batch ``Workspace.convert`` over the folder for those."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )


def start_conversion(
    docs: DataFrame, path: str, checkpoint: str,
    converters: Mapping[str, Converter] | None = None, options: Options = Options(),
) -> StreamingQuery:
    """Appends the conversion of ``docs(path, file_hash, format, content)`` to a table,
    each row exactly once, and ends when all that is there now has been read."""
    return (
        convert(docs, converters, options)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_ledger(records: DataFrame, store: LedgerStore, checkpoint: str) -> StreamingQuery:
    """Upserts ledger rows. A batch writes the run named after the stream and the batch, so a
    batch that is repeated after a failure replaces itself. The stream's id is in its
    checkpoint: one that starts anew does not replace the runs of an earlier one."""

    def save(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]
        store.append(batch, name=f"{stream}#{batch_id}")

    return (
        records.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_workspace(
    docs: DataFrame, workspace: Workspace, run_at: Column, checkpoint: str
) -> StreamingQuery:
    """Plans, converts and records every batch of new files, as a batch run would.

    A repeated batch finds its documents in the ledger, or converts them again into the
    same content-addressed rows.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        workspace.convert(with_format(batch), run_at, by_path=True)

    return (
        docs.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
