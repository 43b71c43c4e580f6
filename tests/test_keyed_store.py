"""Stores that many writers append to, and the states of files."""

import datetime
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from helpers import values
from quire.operators import ledger as ledgers
from quire.operators.convert import convert_text
from quire.options import Options
from quire.plans.run import Workspace
from quire.schemas import LEDGER
from quire.sources import inbox
from quire.sources.file_states import FileStates
from quire.sources.ledger_store import LedgerStore
from quire.sources.objects import create_if_absent, names_in, read_object, write_object

STAMP = "2024-01-01"
OLD = datetime.datetime(2023, 5, 6).timestamp()


def records(spark, *rows, status="success"):
    """Ledger rows of (path, hash) pairs."""
    data = [(path, (path or "").rpartition("/")[2], 3, h, "", "", ".txt", None, status, None, 0)
            for path, h in rows]
    return spark.createDataFrame(data, LEDGER)


def broken(rows):
    """The same rows, but a task that writes them fails."""
    return rows.withColumn("status", F.when(
        F.col("source_path").isNotNull(), F.raise_error(F.lit("lost")).cast("string")))


@pytest.fixture
def store(spark, tmp_path):
    return LedgerStore(spark, str(tmp_path / "ledger"), buckets=4)


# -- commits -----------------------------------------------------------------------


def test_a_repeat_that_fails_leaves_the_committed_run(spark, store):
    day = records(spark, ("/a", "h"), ("/b", "k"), ("/c", "m"))
    store.append(day, name="day 1")
    with pytest.raises(Exception):
        store.append(broken(day), name="day 1")
    assert values(store.read(), "source_path") == [("/a",), ("/b",), ("/c",)]
    assert store.append(records(spark, ("/a", "h"), status="failed"), name="day 1") == 1
    assert values(store.read(), "source_path", "status", "seq") == [("/a", "failed", 1)]


def test_a_run_that_fails_is_nothing(spark, store):
    with pytest.raises(Exception):
        store.append(broken(records(spark, ("/a", "h"))))
    assert store.read().count() == 0
    assert store.append(records(spark, ("/b", "k"))) == 2  # its number is not used again
    assert values(store.read(), "source_path") == [("/b",)]


def test_who_reads_during_a_repeat_sees_the_rows_before(spark, store):
    store.append(records(spark, ("/a", "h"), ("/b", "k")), name="day 1")
    before = store.read()
    seen = []
    save = store._commit

    def commit(c):
        seen.append(store.read().count())  # all is written but the commit
        save(c)

    store._commit = commit
    store.append(records(spark, ("/c", "m")), name="day 1")
    assert seen == [2]
    assert before.count() == 2 and values(store.read(), "source_path") == [("/c",)]


def test_a_commit_that_was_not_finished_does_not_count(spark, store):
    store.append(records(spark, ("/a", "h")))
    store.append(records(spark, ("/b", "k")))
    commit = f"{store.root}/commits/2-0.json"
    text = read_object(spark, commit)
    for part in ("", text[:len(text) // 2]):
        write_object(spark, commit, part)
        assert values(store.read(), "source_path") == [("/a",)]
    assert store.append(records(spark, ("/c", "m"))) == 3


def test_writers_at_once_lose_nothing(spark, store):
    stores = [LedgerStore(spark, store.root, most_runs=3, buckets=4) for _ in range(3)]
    problems, versions = [], []

    def write(k):
        try:
            for i in range(4):
                rows = records(spark, (f"/{k}/{i}", "h"), ("/shared", f"{k}{i}"))
                versions.append(stores[k].append(rows))
        except Exception as problem:  # shown by the main thread
            problems.append(problem)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not problems
    assert len(set(versions)) == 12
    assert values(store.read(), "source_path", "file_hash") == sorted(
        [(f"/{k}/{i}", "h") for k in range(3) for i in range(4)]
        + [("/shared", f"{k}{i}") for k in range(3) for i in range(4)], key=repr)


def test_a_run_that_is_repeated_while_it_is_merged(spark, store):
    store.append(records(spark, ("/a", "h"), ("/b", "k")), name="day 1")
    other = LedgerStore(spark, store.root, buckets=4)
    save = store._save

    def merge_late(rows, version, attempt, kind, name, covers=None):
        if kind == "merge":  # the repeat gets there between the reading and the commit
            other.append(records(spark, ("/a", "h"), status="failed"), name="day 1")
        return save(rows, version, attempt, kind, name, covers)

    store._save = merge_late
    store.compact()
    assert values(store.read(), "source_path", "status") == [("/a", "failed")]

    store._save = save
    commit = other._commit

    def repeat_late(c):
        if c.kind == "run" and c.attempt:
            store.compact()  # the merge gets there first
        commit(c)

    other._commit = repeat_late
    other.append(records(spark, ("/a", "h"), ("/c", "m")), name="day 1")
    assert values(store.read(), "source_path", "status") == [("/a", "success"), ("/c", "success")]


def test_only_one_writer_creates_an_object(spark, tmp_path):
    place, won = f"{tmp_path}/claims/1", []
    threads = [threading.Thread(target=lambda: won.append(create_if_absent(spark, place)))
               for _ in range(8)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sorted(won) == [False] * 7 + [True]
    assert names_in(spark, f"{tmp_path}/none") == []
    assert read_object(spark, f"{tmp_path}/none") is None


# -- buckets -----------------------------------------------------------------------


def bucket_of(spark, path, buckets=4):
    return spark.range(1).select(F.pmod(F.hash(F.lit(path)), F.lit(buckets))).first()[0]


def test_a_merge_writes_only_buckets_with_news(spark, store):
    paths = [f"/{i}" for i in range(40)]
    store.append(records(spark, *[(p, "h") for p in paths]))
    store.compact()
    first = {b: name for c in store._live() for b, name in c.files.items()}
    assert sorted(first) == [0, 1, 2, 3]
    store.append(records(spark, (paths[0], "new")))
    store.compact()
    after = {b: name for c in store._live() for b, name in c.files.items()}
    assert {b for b in first if first[b] != after[b]} == {bucket_of(spark, paths[0])}
    assert sum(c.kind == "run" for c in store._live()) == 0
    assert values(store.read(), "source_path", "file_hash") == sorted(
        [(p, "h") for p in paths] + [(paths[0], "new")], key=repr)


def test_old_files_go_after_the_next_merge(spark, store, tmp_path):
    for round_ in range(6):
        store.append(records(spark, ("/a", "h"), ("/b", f"k{round_}")), name=f"n{round_}")
        store.append(records(spark, ("/a", "h"), ("/b", f"k{round_}")), name=f"n{round_}")
        last = store.read()
        store.compact()
        assert last.count() == round_ + 2  # a reader of the state before is not disturbed
    assert len(os.listdir(tmp_path / "ledger" / "runs")) <= 4
    assert len(os.listdir(tmp_path / "ledger" / "commits")) <= 2 * 4  # with checksums
    assert len(os.listdir(tmp_path / "ledger" / "claims")) <= 6
    assert store.read().count() == 7


def test_a_plan_moves_no_row_of_the_ledger(spark, store):
    store.append(records(spark, *[(f"/{i}", "h") for i in range(40)]))
    store.append(records(spark, *[(f"/{i}", "k") for i in range(10)]))
    docs = spark.createDataFrame(
        [(f"/{i}", f"{i}", 3, "h", ".txt") for i in range(60)],
        "path string, source_filename string, length long, file_hash string, format string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        last = ledgers.last_per(store.read(), "source_path")
        joined = docs.join(last.select(F.col("source_path").alias("path"), "seq"), "path", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        states = ledgers.classify(docs, store.read())
        counts = dict(values(states.groupBy("state").count(), "state", "count"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    left, right = plan.split("Exchange")  # the one exchange is below the documents
    assert "FileScan" not in left and "Bucketed: true" in right
    assert right.index("LocalTableScan" if "LocalTableScan" in right else "Scan ExistingRDD") < right.index("FileScan")
    assert counts == {"unchanged": 30, "modified": 10, "new": 20}


def test_the_first_writer_settles_the_buckets(spark, tmp_path):
    root = str(tmp_path / "l")
    LedgerStore(spark, root, buckets=3).append(records(spark, ("/a", "h")))
    assert LedgerStore(spark, root, buckets=8).buckets == 3
    LedgerStore(spark, root, buckets=8).append(records(spark, ("/b", "h")))
    assert LedgerStore(spark, root).read().count() == 2
    assert LedgerStore(spark, str(tmp_path / "m")).buckets == 4  # partitions of the session


def test_names_with_quotes(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "it's a \"place\""), buckets=2)
    store.append(records(spark, ("/it's", "h"), (None, "k")))
    store.append(records(spark, (None, "k"), status="failed"))
    assert values(store.read(), "source_path", "status") == [("/it's", "success"), (None, "failed")]


# -- states of files ---------------------------------------------------------------


def put(folder, name, data, when=OLD):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_bytes(data)
    os.utime(folder / name, (when, when))


def space_of(spark, tmp_path, **more):
    options = Options(supported=(".txt",), **more)
    return Workspace(spark, str(tmp_path / "out"), options, {".txt": convert_text})


def reasons(plan):
    return dict(values(plan, F.regexp_extract("path", "([^/]*)$", 1).alias("n"), "reason"))


def test_an_unchanged_inbox_is_planned_without_opening_a_file(spark, tmp_path, monkeypatch):
    folder = tmp_path / "inbox"
    for i in range(5):
        put(folder, f"{i}.txt", b"text %d" % i)
    put(folder, "odd.bin", b"never opened")
    space = space_of(spark, tmp_path)
    opened = []
    real = FileStates._opened
    monkeypatch.setattr(
        FileStates, "_opened", lambda self, files: opened.append(files.count()) or real(self, files))
    space.convert_folder(str(folder), F.lit(STAMP))
    assert opened == [5]
    plan = reasons(space.plan(inbox.scan(spark, str(folder)), by_path=True))
    assert opened == [5, 0] and set(plan.values()) == {"Already converted", "Unsupported format: .bin"}

    # a new file, a longer one, a touched one with the same bytes
    put(folder, "new.txt", b"new")
    put(folder, "1.txt", b"longer text 1")
    put(folder, "2.txt", b"text 2", when=OLD + 60)
    plan = reasons(space.plan(inbox.scan(spark, str(folder)), by_path=True))
    assert opened[2:] == [3]
    assert plan["new.txt"] == "New" and plan["1.txt"] == "Modified (re-conversion needed)"
    assert plan["2.txt"] == plan["3.txt"] == "Already converted"
    space.convert_folder(str(folder), F.lit(STAMP))
    assert opened[3:] == [0]  # the plan has hashed them


def test_verify_opens_every_file(spark, tmp_path):
    folder = tmp_path / "inbox"
    put(folder, "a.txt", b"same length")
    space_of(spark, tmp_path).convert_folder(str(folder), F.lit(STAMP))
    put(folder, "a.txt", b"SAME LENGTH")  # length and time are as they were
    scan = inbox.scan(spark, str(folder))
    assert reasons(space_of(spark, tmp_path).plan(scan, True)) == {"a.txt": "Already converted"}
    assert reasons(space_of(spark, tmp_path, verify=True).plan(scan, True)) == {
        "a.txt": "Modified (re-conversion needed)"}


def test_a_file_that_just_changed_is_opened_again(spark, tmp_path):
    folder = tmp_path / "inbox"
    now = datetime.datetime.now().timestamp()
    put(folder, "a.txt", b"one", when=now)
    space = space_of(spark, tmp_path, settled_seconds=3600)
    space.convert_folder(str(folder), F.lit(STAMP))
    assert space.states.read().count() == 0
    put(folder, "a.txt", b"two", when=now)
    assert reasons(space.plan(inbox.scan(spark, str(folder)), True)) == {
        "a.txt": "Modified (re-conversion needed)"}


def test_files_that_vanish_or_have_no_length(spark, tmp_path):
    put(tmp_path / "inbox", "a.txt", b"a")
    states = FileStates(spark, str(tmp_path / "states"), buckets=2)
    path = f"file:{tmp_path}/inbox/a.txt"
    files = spark.createDataFrame(
        [(path, 1, datetime.datetime(2020, 1, 1)), ("file:/none/b.txt", 1, None),
         ("file:/none/c.txt", None, None), (None, 1, None)],
        "path string, length long, modificationTime timestamp")
    for _ in range(2):
        found = dict(values(states.hashed(files.where("path is not null")), "path", "file_hash"))
        assert found[path] == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
        assert found["file:/none/b.txt"] is None and found["file:/none/c.txt"] is None
    assert values(states.read(), "path", "length") == [(path, 1)]
    assert states.hashed(files.limit(0)).count() == 0


def test_commits_are_small_json(spark, store):
    store.append(records(spark, ("/a", "h")), name="x")
    commit = json.loads(read_object(spark, f"{store.root}/commits/1-0.json"))
    assert commit["kind"] == "run" and commit["name"] == "x" and len(commit["files"]) == 1
