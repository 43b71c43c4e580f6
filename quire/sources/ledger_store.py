"""The ledger on shared storage."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.operators.ledger import KEY
from quire.schemas import LEDGER
from quire.sources.keyed_store import MOST_RUNS, KeyedStore


class LedgerStore(KeyedStore):
    """Ledger records by (source_path, file_hash), bucketed by path: a plan, which asks for
    the last record of each path, moves only the documents. See ``KeyedStore``."""

    def __init__(
        self, spark: SparkSession, root: str, most_runs: int = MOST_RUNS, buckets: int | None = None
    ):
        super().__init__(spark, root, LEDGER, KEY, most_runs, buckets)
