"""The four things a user does: convert a folder, preview that, ask for the status,
validate the outputs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import file_stem, fingerprint, is_supported, markdown_name
from quire.operators import ledger as ledgers
from quire.operators import validate as checks
from quire.operators.convert import (
    Converter,
    attachments_path,
    convert,
    convert_files,
)
from quire.operators.skew import cut_lineage, lookup_join
from quire.options import Options
from quire.session import scratch
from quire.sources import inbox
from quire.sources.file_states import FileStates
from quire.sources.ledger_store import LedgerStore
from quire.sources.manifest import is_missing


CONTENT = ["file_hash", "format"]


@dataclass
class Workspace:
    """Where a collection's outputs live, and how it is converted."""

    spark: SparkSession
    root: str
    options: Options = field(default_factory=Options)
    converters: Mapping[str, Converter] | None = None

    @property
    def ledger(self) -> LedgerStore:
        return LedgerStore(self.spark, f"{self.root}/ledger")

    @property
    def states(self) -> FileStates:
        return FileStates(self.spark, f"{self.root}/states")

    def converted(self) -> DataFrame | None:
        """The current conversion of every content that the ledger knows; None before the
        first run. A content that was converted again counts with its last run."""
        runs = self._runs()
        return None if runs is None else self._current(runs)

    def _runs(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/converted")
        except AnalysisException as problem:
            if is_missing(problem):
                return None
            raise

    def _current(self, rows: DataFrame) -> DataFrame:
        last = self.ledger.read().groupBy("file_hash", "format").agg(F.max("seq").alias("run"))
        return rows.join(last, ["file_hash", "format", "run"], "left_semi")

    # -- runs --------------------------------------------------------------

    def plan(self, docs: DataFrame, by_path: bool = False) -> DataFrame:
        """What a run over ``docs`` (see ``inbox.scan``) would do; nothing is converted."""
        hashed = cut_lineage(self._hashed(docs, by_path), "hashed")
        return ledgers.build_plan(hashed, self.ledger.read(), self.options)

    def convert(self, docs: DataFrame, run_at: Column, by_path: bool = False) -> DataFrame:
        """Converts what is pending and returns one result row per document of ``docs``, with
        the reason for those left out; the rows stay in ``results`` of the run.

        With ``by_path`` the documents are files, as those of ``inbox.scan``: the tasks open
        the pending ones themselves, so no other file is read again and no bytes are
        shuffled. Without it they are rows of a table with their ``content``.
        """
        version = self.ledger.claim()
        with scratch(self.spark):
            plan = cut_lineage(self.plan(docs, by_path), "plan")
            pending = plan.where(F.col("action") == "process")
            self._convert_new_contents(docs, pending, version, by_path)
            results = self._results(plan, pending, version)
            results.write.mode("overwrite").parquet(self._results_of(version))
        results = self.results(version)
        records = ledgers.build_records(results, run_at, version, self.options)
        self.ledger.append(records, version=version)
        return results

    def convert_folder(self, folder: str, run_at: Column) -> DataFrame:
        """Converts what is pending among the files below a folder."""
        return self.convert(inbox.scan(self.spark, folder), run_at, by_path=True)

    def results(self, version: int) -> DataFrame:
        """The report of one run: a row per document."""
        return self.spark.read.parquet(self._results_of(version))

    def _results_of(self, version: int) -> str:
        return f"{self.root}/results/run={version}"

    def status(self) -> DataFrame:
        return ledgers.status(self.ledger.read())

    def validate(self) -> DataFrame:
        """Findings; ``checks.summary`` makes one row of them.

        Whether an output is there is asked by content, which is its key: names may be shared.
        Links are taken from the texts before anything is joined, and looked up once per
        content. Only the missing ones meet the records that share that content.
        """
        runs = self._runs()
        ledger = self.ledger.read()
        if runs is None:
            nothing = self.spark.createDataFrame(
                [], "file_hash string, format string, output_attachments string")
            return checks.missing_outputs(ledger, nothing, nothing, CONTENT)
        group = attachments_path(F.col("file_hash"), self.options)
        content = [*CONTENT, "run"]
        # only the folders of runs that some record still refers to are read
        live = [row["seq"] for row in ledger.select("seq").distinct().collect()]
        texts = runs.where((F.col("status") == "success") & F.col("run").isin(live))
        all_links = checks.image_links(texts, *content)
        links = cut_lineage(self._current(all_links).select(*CONTENT, "ref"), "links")
        names = texts.select(*content, F.explode("images.name").alias("name"))
        stored = self._current(names).select(F.concat(group, F.lit("/"), "name").alias("ref"))
        current = self._current(texts.select(*content))
        done = current.select(*CONTENT, group.alias("output_attachments")).distinct()
        return checks.validate(ledger, done, links, done, stored, keys=CONTENT)

    # -- steps -------------------------------------------------------------

    def _hashed(self, docs: DataFrame, by_path: bool) -> DataFrame:
        """Documents without their bytes, which are read again only for pending ones.

        Lengths are filters of the scan, so the bytes of documents above ``max_bytes`` are
        not read. Of files, only those whose state differs from the remembered one are
        opened, and none of a format that is not supported.
        """
        narrow = ["path", "source_filename", "length", "format"]
        limit = self.options.max_bytes
        fits = F.lit(True) if limit is None else F.col("length") <= limit
        if by_path:
            fits &= is_supported(F.col("format"), self.options.supported)
            files = docs.where(fits).select(*narrow, "modificationTime")
            hashed = self.states.hashed(
                files, self.options.verify, self.options.settled_seconds).select(
                *narrow, "file_hash")
        else:
            hashed = docs.where(fits).select(
                *narrow, fingerprint(F.col("content")).alias("file_hash"))
            if limit is None:
                return hashed
        rest = docs.where(~fits).select(*narrow, F.lit(None).cast("string").alias("file_hash"))
        return hashed.unionByName(rest)

    def _convert_new_contents(
        self, docs: DataFrame, pending: DataFrame, version: int, by_path: bool
    ) -> None:
        """Each distinct content is converted once, through one of its paths."""
        chosen = pending.where("file_hash is not null").groupBy("file_hash", "format").agg(
            F.min("path").alias("path"), F.first("length").alias("length"))
        if by_path:
            chosen = cut_lineage(chosen, "chosen")
            converted = convert_files(chosen, self.converters, self.options)
        else:
            todo = docs.select("path", "content").join(chosen, "path")
            converted = convert(todo, self.converters, self.options, check_hash=True)
        converted.write.mode("overwrite").parquet(f"{self.root}/converted/run={version}")

    def _results(self, plan: DataFrame, pending: DataFrame, version: int) -> DataFrame:
        """One row per path: converted contents joined back to all their paths."""
        run = self.spark.read.parquet(f"{self.root}/converted/run={version}")
        outcome = run.select("file_hash", "format", "status", "error", "title", "image_count")
        columns = ["path", "source_filename", "length", "file_hash", "format"]
        known = pending.where(F.col("file_hash").isNotNull())
        done = lookup_join(
            known.select(*columns), outcome, ["file_hash", "format"], "left", "path")
        oversized = pending.where(F.col("file_hash").isNull()).select(
            *columns, F.lit("failed").alias("status"),
            F.lit("no content, or larger than the size limit").alias("error"))
        left_out = plan.where(F.col("action") != "process").select(
            *columns, F.lit("skipped").alias("status"),
            F.when(F.col("action") == "unsupported", F.col("reason")).alias("error"),
            F.col("reason"))
        everything = done.unionByName(oversized, allowMissingColumns=True).unionByName(
            left_out, allowMissingColumns=True)
        name = markdown_name(file_stem(F.col("path")), F.col("title"))
        return everything.select(
            *columns, "status", "error", "reason",
            F.when(F.col("status") == "success", name).alias("md_filename"),
            F.coalesce("image_count", F.lit(0)).alias("image_count"))


EMPTY = "No documents found"


def convert_folder(
    spark: SparkSession, folder: str, root: str, run_at: Column | None = None,
    options: Options = Options(), converters: Mapping[str, Converter] | None = None,
) -> DataFrame:
    """Scan, convert and record a folder; the result is one row of counts, with a message if
    there was nothing. ``Workspace.results`` has the rows per document."""
    workspace = Workspace(spark, root, options, converters)
    stamp = F.current_timestamp() if run_at is None else run_at
    counts = ledgers.batch_stats(workspace.convert_folder(folder, stamp))
    return counts.withColumn("message", F.when(F.col("scanned") == 0, EMPTY))
