"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_ONE_MACHINE = re.compile(r"local(\[.*\])?$")
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def tuned(builder):
    """Settings that the operators rely on or profit from."""
    return (
        builder
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Rows hold whole documents, so Arrow batches must stay short.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    )


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one the cluster shares.

    Without that setting it is a fresh temporary folder, on a single machine only: on a
    cluster, each executor would write to its own disk.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not _ONE_MACHINE.match(master):
            raise RuntimeError(
                f"set {CHECKPOINT_CONF} to a folder that all machines share; master is {master}")
        base = tempfile.mkdtemp(prefix="quire-")
    folder = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    held = _scratch.get()
    if held is not None:
        held.append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Shared folders that are asked for inside are deleted at the end."""
    held: list[str] = []
    token = _scratch.set(held)
    try:
        yield
    finally:
        _scratch.reset(token)
        for folder in held:
            remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the library's own tables, in any store Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over.

    It does when the driver's JVM finds that no plan refers to them, which may take as long
    as the driver has memory left.
    """
    spark._jvm.System.gc()


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give a Python stage one task per core when the scan has fewer splits.

    A scan that already has enough splits is returned as it is: a large corpus is
    never shuffled only to feed Python. ``scan`` must be a plain scan; for one of
    those, asking for the number of splits runs no job.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= wanted:
        return scan
    return scan.repartition(wanted, *keys)
