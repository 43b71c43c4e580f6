"""What is known of files: the hash that a path had at a length and a modification time."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.convert import TASK_BYTES
from quire.operators.skew import cut_lineage
from quire.schemas import FILE_STATE
from quire.sources.files import hashed_by_path
from quire.sources.keyed_store import MOST_RUNS, KeyedStore


class FileStates(KeyedStore):
    """Hashes of files by path, bucketed by path. See ``KeyedStore``."""

    def __init__(
        self, spark: SparkSession, root: str, most_runs: int = MOST_RUNS, buckets: int | None = None
    ):
        super().__init__(spark, root, FILE_STATE, ["path"], most_runs, buckets)

    def hashed(
        self, files: DataFrame, verify: bool = False, settled_seconds: float = 2.0
    ) -> DataFrame:
        """``files(path, length, modificationTime, …)`` with their ``file_hash``; null where a
        file cannot be read.

        A file whose length and time are those of its state has the hash of that state and is
        not opened, unless ``verify`` is set. All others are opened, by their paths, in tasks
        of about equal bytes, and their states are remembered. A file that changed within the
        last ``settled_seconds`` is not remembered: it could change again without a new time.
        A file that cannot be read is not remembered either.
        """
        started = datetime.datetime.now(datetime.timezone.utc)
        last = self.read().select(
            "path", F.col("length").alias("_length"), F.col("modified_at").alias("_at"),
            F.col("file_hash").alias("_hash"))
        same = (F.col("length") == F.col("_length")) & (F.col("modificationTime") == F.col("_at"))
        met = files.join(last, "path", "left").withColumn(
            "file_hash", F.when(same & ~F.lit(verify), F.col("_hash")))
        met = cut_lineage(met.select(*files.columns, "file_hash"), "file-states")
        known = met.where("file_hash is not null")
        opened = cut_lineage(self._opened(met.where("file_hash is null").drop("file_hash")), "opened")
        before = F.lit(started - datetime.timedelta(seconds=settled_seconds))
        fresh = opened.where(F.col("file_hash").isNotNull() & (F.col("modificationTime") < before))
        if not fresh.isEmpty():
            self.append(fresh.select(
                "path", "length", F.col("modificationTime").alias("modified_at"), "file_hash"))
        return known.unionByName(opened)

    def _opened(self, files: DataFrame) -> DataFrame:
        total = files.agg(F.sum("length")).first()[0]
        if total is None:  # none, or none that has a length
            return hashed_by_path(files)
        cores = self.spark.sparkContext.defaultParallelism
        return hashed_by_path(files.repartition(max(cores, -(-total // TASK_BYTES)), "path"))
