"""A table of rows by key on shared storage: appended by many writers, merged by buckets."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import remove
from quire.sources.objects import create_if_absent, names_in, read_object, write_object

MOST_RUNS = 64

_COMMIT = re.compile(r"(\d+)-(\d+)\.json$")
_CLAIM = re.compile(r"(\d+)-(\d+)$")
_BUCKET = re.compile(r"_(\d+)\.c\d+\.")


@dataclass
class Commit:
    """One run or merge that counts: its files by bucket, and the files of others (by run
    and bucket) whose rows a merge has taken in."""

    version: int
    attempt: int
    kind: str
    name: str | None
    folder: str
    files: dict[int, str]
    covers: dict[str, list[int]] = field(default_factory=dict)
    drops: list[str] = field(default_factory=list)

    @property
    def id(self) -> str:
        return f"{self.version}-{self.attempt}"


class KeyedStore:
    """Runs of rows ``schema`` (with a number ``seq``), of which the last one per ``keys``
    counts, in immutable folders, and small commit objects that say which folders count.

    A writer first claims a number, by creating an object that must not be there; so two
    writers never have one number, and neither waits for the other. It writes its rows into
    a folder of its own, and the commit last. A run that fails has no commit and is nothing.
    A named run that is repeated is another attempt at the same number, in another folder:
    until its commit is there, readers see the rows of the attempt before.

    Rows are bucketed by a hash of ``by``, the first key, and sorted by it. Every
    ``most_runs`` runs, the buckets with news are merged with what they held, and no other
    bucket is written. A reader sees one bucketed table of all files that count, so grouping
    by ``by``, or joining on it, moves no row of the store. What a merge replaces stays until
    the next one. Bucketed tables need a name for a moment: it is taken in the current
    database of the session and dropped at once; the files belong to the store.
    """

    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str],
        most_runs: int = MOST_RUNS, buckets: int | None = None,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.keys = list(keys)
        self.by = self.keys[0]
        self.most_runs = most_runs
        self._wanted_buckets = buckets

    # -- what counts -----------------------------------------------------------

    @property
    def buckets(self) -> int:
        """Settled by the first writer: as many as were asked for, or as its session has
        partitions in a shuffle."""
        found = names_in(self.spark, f"{self.root}/layout")
        if not found:
            wanted = self._wanted_buckets or self.spark.conf.get("spark.sql.shuffle.partitions")
            create_if_absent(self.spark, f"{self.root}/layout/{wanted}")
            found = names_in(self.spark, f"{self.root}/layout")
        # of several first writers the smallest number counts for all
        return min(int(name) for name in found if name.isdigit())

    def read(self) -> DataFrame:
        """The last row per key; empty if nothing was written."""
        return last_per(self._rows(self._live()), self.keys)

    def next_version(self) -> int:
        """The number after the last run that counts. Writers claim theirs with ``claim``."""
        return max((commit.version for commit in self._commits()), default=0) + 1

    def claim(self) -> int:
        """A number that no other writer has or gets."""
        version = max([self.next_version() - 1, *self._claimed()], default=0) + 1
        while not create_if_absent(self.spark, self._claim(version, 0)):
            version += 1
        return version

    # -- writing ---------------------------------------------------------------

    def append(
        self, records: DataFrame, name: str | None = None, version: int | None = None
    ) -> int:
        """Adds records as one run and returns its number, which is their ``seq``; a claimed
        ``version`` may be given. A caller that may repeat itself gives the run a name: its
        rows then replace those of the run of that name, or follow them if those have been
        merged already."""
        before = self._repeatable(name)
        if before is None:
            version, attempt = version or self.claim(), 0
        else:
            version, attempt = before.version, self._claim_attempt(before)
        commit = self._save(records, version, attempt, "run", name)
        if before is not None and self._was_merged(before):
            # a merge took the old rows in while these were written: they follow it
            return self.append(records, name, self.claim())
        if sum(c.kind == "run" for c in self._live()) > self.most_runs:
            self.compact()
        return commit.version

    def compact(self) -> int:
        """Merges the buckets with runs in them; returns the number of the merge."""
        live = self._live()
        news = {bucket for c in live if c.kind == "run" for bucket in c.files}
        covers = {c.id: sorted(news & set(c.files)) for c in live}
        taken = [
            Commit(c.version, c.attempt, c.kind, c.name, c.folder,
                   {b: c.files[b] for b in covers[c.id]}) for c in live]
        version = self.claim()
        rows = last_per(self._rows(taken), self.keys)
        older = [c for c in self._commits() if c.kind == "merge"]
        merge = self._save(
            rows, version, 0, "merge", None, {k: v for k, v in covers.items() if v})
        now = {c.id for c in self._current()}
        replaced = [c for c in live if c.kind == "run" and c.id not in now]
        if replaced:
            # a run was repeated meanwhile: the merge holds its old rows and does not count
            self._commit(Commit(self.claim(), 0, "drop", None, "", {}, drops=[merge.id]))
        elif older:
            self._forget(older)
        return version

    def _save(self, rows, version, attempt, kind, name, covers=None) -> Commit:
        folder = f"v{version}-{attempt}-{uuid.uuid4().hex}"
        if kind == "run":
            rows = rows.withColumn("seq", F.lit(version).cast("long"))
        files = self._write(rows.select(*self.schema.fieldNames()), folder)
        commit = Commit(version, attempt, kind, name, folder, files, covers or {})
        self._commit(commit)
        return commit

    def _commit(self, commit: Commit) -> None:
        content = {key: value for key, value in commit.__dict__.items()}
        write_object(
            self.spark, f"{self.root}/commits/{commit.id}.json", json.dumps(content))

    def _write(self, rows: DataFrame, folder: str) -> dict[int, str]:
        """Bucketed and sorted files, one per bucket that has rows; returns their names."""
        place, table = f"{self.root}/runs/{folder}", f"quire_{uuid.uuid4().hex}"
        buckets = self.buckets
        rows.repartition(buckets, self.by).write.format("parquet").bucketBy(
            buckets, self.by).sortBy(self.by).option("path", place).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")
        names = [name for name in names_in(self.spark, place) if name.startswith("part-")]
        files: dict[int, str] = {}
        for name in names:
            found = _BUCKET.search(name)
            if found:
                files[int(found[1])] = name
        return files

    # -- reading ---------------------------------------------------------------

    def _rows(self, commits: list[Commit]) -> DataFrame:
        """All rows of the files that count, as one bucketed table."""
        names = [name for c in commits for name in c.files.values()]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        table = f"quire_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        place = f"{self.root}/runs".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet "
            f"OPTIONS (recursiveFileLookup 'true', pathGlobFilter '{{{','.join(names)}}}') "
            f"CLUSTERED BY (`{self.by}`) SORTED BY (`{self.by}`) INTO {self.buckets} BUCKETS "
            f"LOCATION '{place}'")
        rows = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay, and so does the plan
        return rows

    def _commits(self) -> list[Commit]:
        """Every whole commit, in order. One that a writer did not finish does not count."""
        found = []
        for name in names_in(self.spark, f"{self.root}/commits"):
            if not _COMMIT.match(name):
                continue
            text = read_object(self.spark, f"{self.root}/commits/{name}")
            try:
                content = json.loads(text or "")
            except json.JSONDecodeError:
                continue
            content["files"] = {int(k): v for k, v in content["files"].items()}
            found.append(Commit(**content))
        return sorted(found, key=lambda c: (c.version, c.attempt))

    def _current(self) -> list[Commit]:
        """The last attempt of every run, and the merges that were not dropped."""
        commits = self._commits()
        dropped = {i for c in commits for i in c.drops}
        last = {c.version: c for c in commits if c.id not in dropped}
        return [c for c in last.values() if c.kind != "drop"]

    def _live(self) -> list[Commit]:
        """What counts, each with the files that no merge has taken in."""
        current = self._current()
        taken = {(i, b) for c in current for i, buckets in c.covers.items() for b in buckets}
        live = []
        for c in current:
            c.files = {b: name for b, name in c.files.items() if (c.id, b) not in taken}
            if c.files:
                live.append(c)
        return live

    # -- attempts, claims, old files -------------------------------------------

    def _repeatable(self, name: str | None) -> Commit | None:
        """The run of a name, if no merge holds rows of it."""
        runs = [c for c in self._current() if name is not None and c.kind == "run" and c.name == name]
        return runs[-1] if runs and not self._was_merged(runs[-1]) else None

    def _was_merged(self, run: Commit) -> bool:
        """Whether a merge holds rows of any attempt at a run."""
        return any(
            i.startswith(f"{run.version}-") for c in self._current() for i in c.covers)

    def _claim_attempt(self, before: Commit) -> int:
        attempt = before.attempt + 1
        while not create_if_absent(self.spark, self._claim(before.version, attempt)):
            attempt += 1
        return attempt

    def _claim(self, version: int, attempt: int) -> str:
        return f"{self.root}/claims/{version}-{attempt}"

    def _claimed(self) -> list[int]:
        found = (_CLAIM.match(name) for name in names_in(self.spark, f"{self.root}/claims"))
        return [int(match[1]) for match in found if match]

    def _forget(self, older: list[Commit]) -> None:
        """Deletes the files that merges before the last one took in, and attempts that were
        replaced before those; no reader of the present or the last state needs them."""
        newest = older[-1]
        current = {c.id: c for c in self._current()}
        taken = {(i, b) for c in older for i, buckets in c.covers.items() for b in buckets}
        for c in self._commits():
            if c.version >= newest.version:
                continue
            gone = {b for b in c.files if (c.id, b) in taken or c.id not in current}
            if len(gone) == len(c.files):
                # the commit goes last, so that an interrupted clean-up is taken up again
                if c.folder:
                    remove(self.spark, f"{self.root}/runs/{c.folder}")
                remove(self.spark, f"{self.root}/commits/{c.id}.json")
            else:
                for b in gone:
                    remove(self.spark, f"{self.root}/runs/{c.folder}/{c.files[b]}")
        for version in set(self._claimed()):
            if version < newest.version:
                for name in names_in(self.spark, f"{self.root}/claims"):
                    if name.startswith(f"{version}-"):
                        remove(self.spark, f"{self.root}/claims/{name}")


def last_per(rows: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The row with the highest ``seq`` per key; partial maxima come before any shuffle."""
    others = [c for c in rows.columns if c not in keys]
    order = F.struct("seq", *tie)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r"))
    return newest.select(*keys, "r.*").select(*rows.columns)
