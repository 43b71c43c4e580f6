"""Whole runs over folders, and streams."""

import os

import pytest
from pyspark.sql import functions as F

from helpers import book, text_only, values
from quire.operators import validate as checks
from quire.operators.convert import (
    attachments,
    convert_html,
    convert_text,
    default_converters,
)
from quire.operators.ledger import batch_stats
from quire.options import Options
from quire.plans.run import Workspace, convert_folder
from quire.sources import inbox
from quire.sources.output_tree import (
    list_tree,
    output_folders,
    output_markdown,
    require_output,
)
from quire.sources.sinks import (
    export_attachments,
    export_markdown,
    read_attachments,
    read_markdown,
    read_stored_attachments,
    write_attachments,
    write_converted,
    write_markdown,
)
from quire.streaming.ingest import document_stream, start_ledger, start_workspace

OPTIONS = Options(supported=(".epub", ".txt", ".html"))
CONVERTERS = default_converters() | {".txt": convert_text, ".html": convert_html}
STAMP = "2024-01-01"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "inbox"
    (root / "sub").mkdir(parents=True)
    (root / "a.epub").write_bytes(book())
    (root / "B.EPUB").write_bytes(text_only())
    (root / "sub" / "c.txt").write_bytes(b"hello world")
    (root / "sub" / "copy.txt").write_bytes(b"hello world")
    (root / "bad.epub").write_bytes(b"not a zip")
    (root / "d.odt").write_bytes(b"?")
    (root / "_hidden.txt").write_bytes(b"x")
    (root / ".dot.txt").write_bytes(b"x")
    return root


def workspace(spark, tmp_path, **more):
    options = Options(supported=OPTIONS.supported, **more)
    return Workspace(spark, str(tmp_path / "out"), options, CONVERTERS)


def outcome(results):
    rows = values(results, F.regexp_extract("path", "inbox/(.*)$", 1).alias("p"), "status", "error",
                  "md_filename", "image_count")
    return {row[0]: row[1:] for row in rows}


def actions(plan):
    return dict(values(plan, F.regexp_extract("path", "inbox/(.*)$", 1).alias("p"), "reason"))


def test_scan_lists_every_visible_file(spark, folder):
    docs = inbox.scan(spark, str(folder))
    assert values(docs, "source_filename", "format", "length") == [
        ("B.EPUB", ".epub", len(text_only())), ("a.epub", ".epub", len(book())),
        ("bad.epub", ".epub", 9), ("c.txt", ".txt", 11), ("copy.txt", ".txt", 11), ("d.odt", ".odt", 1)]
    assert inbox.supported(docs, OPTIONS).count() == 5


def test_a_scan_without_content_reads_no_bytes(spark, folder):
    docs = inbox.supported(inbox.scan(spark, str(folder)), OPTIONS).where("length < 100")
    text = docs.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in text.split("ReadSchema")[1]
    assert "LessThan(length,100)" in text


def test_convert_then_skip_then_modify_then_force(spark, folder, tmp_path):
    space = workspace(spark, tmp_path)
    first = outcome(space.convert(inbox.scan(spark, str(folder)), F.lit(STAMP)))
    assert first == {
        "a.epub": ("success", None, "Test Book.md", 1), "B.EPUB": ("success", None, "Text Only.md", 0),
        "sub/c.txt": ("success", None, "c.md", 0), "sub/copy.txt": ("success", None, "copy.md", 0),
        "bad.epub": ("failed", "File is not a zip file", None, 0),
        "d.odt": ("skipped", "Unsupported format: .odt", None, 0)}
    assert space.status().first().asDict() == {"total": 5, "success": 4, "failed": 1}

    again = space.convert(inbox.scan(spark, str(folder)), F.lit(STAMP))
    assert batch_stats(again).first().asDict() == {
        "scanned": 6, "processed": 0, "skipped": 6, "failed": 0}

    (folder / "sub" / "c.txt").write_bytes(b"changed")
    os.rename(folder / "a.epub", folder / "sub" / "a.epub")
    (folder / "new.html").write_bytes(b"<p>n</p>")
    assert actions(space.plan(inbox.scan(spark, str(folder)))) == {
        "B.EPUB": "Already converted", "bad.epub": "Already converted",
        "sub/copy.txt": "Already converted", "sub/c.txt": "Modified (re-conversion needed)",
        "sub/a.epub": "Already converted under another path", "new.html": "New",
        "d.odt": "Unsupported format: .odt"}
    third = outcome(space.convert(inbox.scan(spark, str(folder)), F.lit(STAMP)))
    assert {name for name, row in third.items() if row[0] == "success"} == {"sub/c.txt", "new.html"}
    assert "Modified" not in " ".join(actions(space.plan(inbox.scan(spark, str(folder)))).values())

    forced = workspace(spark, tmp_path, force=True)
    fourth = outcome(forced.convert(inbox.scan(spark, str(folder)), F.lit(STAMP)))
    assert fourth["B.EPUB"][0] == "success" and fourth["bad.epub"][0] == "failed"
    texts = forced.converted().where("status = 'success'")
    assert texts.count() == texts.select("file_hash", "format").distinct().count()

    retry = workspace(spark, tmp_path, retry_failed=True)
    assert actions(retry.plan(inbox.scan(spark, str(folder))))["bad.epub"] == "Failed before"


def test_outputs_are_valid_and_losses_are_found(spark, folder, tmp_path):
    space = workspace(spark, tmp_path)
    space.convert(inbox.scan(spark, str(folder)), F.lit(STAMP))
    found = space.validate()
    assert values(found, "severity", "kind") == [("warning", "no_output")]
    assert checks.summary(found, space.ledger.read()).first()["is_valid"]

    empty = workspace(spark, tmp_path / "other")
    assert empty.validate().count() == 0
    lost = Workspace(spark, str(tmp_path / "lost"), OPTIONS, CONVERTERS)
    lost.ledger.append(space.ledger.read())
    kinds = values(lost.validate().groupBy("severity", "kind").count(), "severity", "kind", "count")
    assert kinds == [("error", "missing_markdown", 4), ("warning", "no_output", 1)]


def test_documents_above_the_limit_fail(spark, folder, tmp_path):
    space = workspace(spark, tmp_path, max_bytes=11)
    rows = outcome(space.convert(inbox.scan(spark, str(folder)), F.lit(STAMP)))
    assert rows["a.epub"][0] == "failed" and "size limit" in rows["a.epub"][1]
    assert rows["sub/c.txt"][0] == "success"


def test_a_file_above_the_limit_of_the_reader_does_not_end_the_run(spark, folder, tmp_path):
    setting = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(setting, 11)
    try:
        rows = outcome(workspace(spark, tmp_path).convert_folder(str(folder), F.lit(STAMP)))
    finally:
        spark.conf.unset(setting)
    # tasks open the files themselves, so the limit of the reader is none of theirs
    assert rows["a.epub"][0] == rows["sub/c.txt"][0] == "success"
    assert rows["bad.epub"][0] == "failed"


def test_no_bytes_are_shuffled_for_files(spark, folder, tmp_path):
    from quire.operators.convert import convert_files

    files = inbox.scan(spark, str(folder)).select(
        "path", "format", "length", F.lit("h").alias("file_hash"))
    plan = convert_files(files, CONVERTERS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "content" not in plan


def test_a_file_that_changed_since_the_plan_fails(spark, folder, tmp_path):
    from quire.operators.convert import convert_files

    files = inbox.scan(spark, str(folder)).where("format = '.txt'").select(
        "path", "format", "length", F.lit("another").alias("file_hash"))
    assert set(values(convert_files(files, CONVERTERS), "status", "error")) == {
        ("failed", "changed during the run")}


def test_nothing_is_left_in_the_shared_folder(spark, folder, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr("quire.session.CHECKPOINT_CONF", "spark.not.set")
    monkeypatch.setattr(
        type(spark.sparkContext), "getCheckpointDir", lambda self: f"file:{shared}")
    workspace(spark, tmp_path).convert_folder(str(folder), F.lit(STAMP))
    assert not list(shared.iterdir())


def test_a_lost_content_is_found_behind_another_of_its_name(spark, tmp_path):
    inbox_dir = tmp_path / "inbox"
    inbox_dir.mkdir()
    (inbox_dir / "x.txt").write_bytes(b"here")
    space = workspace(spark, tmp_path)
    space.convert_folder(str(inbox_dir), F.lit(STAMP))
    good = space.ledger.read()
    space.ledger.append(good.withColumns(
        {"source_path": F.lit("/y/x.txt"), "file_hash": F.lit("never converted")}))
    found = space.validate()
    assert values(found, "kind", "path") == [("missing_markdown", "x.md")]
    assert not checks.summary(found, space.ledger.read()).first()["is_valid"]


def test_files_for_people(spark, folder, tmp_path):
    space = workspace(spark, tmp_path)
    space.convert_folder(str(folder), F.lit(STAMP))
    rows = space.results(1).select("path", "file_hash", "format", "md_filename")
    texts = space.converted().select("file_hash", "format", "status", "md")
    named = rows.join(texts, ["file_hash", "format"])
    assert export_markdown(named, str(tmp_path / "export")).count() == 4
    found = sorted(p.name for p in (tmp_path / "export").iterdir())
    assert found == ["Test Book.md", "Text Only.md", "c.md", "copy.md"]
    pictures = attachments(space.converted())
    export_attachments(pictures, str(tmp_path / "export")).collect()
    assert [p.name for p in (tmp_path / "export" / "attachments").glob("*/*")] == ["cover.png"]


def test_one_call_for_a_folder(spark, folder, tmp_path):
    row = convert_folder(spark, str(folder), str(tmp_path / "o"), options=OPTIONS, converters=CONVERTERS)
    assert row.first().asDict() == {
        "scanned": 6, "processed": 4, "skipped": 1, "failed": 1, "message": None}
    (tmp_path / "nothing").mkdir()
    none = convert_folder(spark, str(tmp_path / "nothing"), str(tmp_path / "p"))
    assert none.first().asDict() == {
        "scanned": 0, "processed": 0, "skipped": 0, "failed": 0, "message": "No documents found"}


def test_sinks(spark, folder, tmp_path):
    from quire.operators.convert import convert

    docs = inbox.supported(inbox.scan(spark, str(folder)), OPTIONS)
    done = convert(docs.withColumn("file_hash", F.sha2("content", 256)), CONVERTERS, OPTIONS)
    write_converted(done, str(tmp_path / "converted"))
    assert read_markdown(spark, str(tmp_path / "converted")).count() == 4
    images = read_attachments(spark, str(tmp_path / "converted"))
    write_attachments(images, str(tmp_path / "attachments"))
    write_markdown(spark.read.parquet(str(tmp_path / "converted")), str(tmp_path / "markdown"))
    stored = read_stored_attachments(spark, str(tmp_path / "attachments"))
    assert values(stored, "hash_prefix", "name") == values(images, "hash_prefix", "name")
    assert spark.read.parquet(str(tmp_path / "markdown")).count() == 4


def test_output_tree(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"doc/auto/doc.md": "# D", "doc/auto/images/p.png": "p", "two/images/q.png": "q",
                       "two/x.md": "x", "two/deep/y.md": "yy", "stray.md": "s"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = list_tree(spark, str(root))
    folders = require_output(output_folders(files, str(root)), str(root))
    assert values(folders, "subdir", "md_count", "images_dir") == [
        (f"{root}/doc", 1, None), (f"{root}/two", 2, f"{root}/two/images")]
    assert values(output_markdown(files, str(root)), "md_file", "length") == [
        (f"{root}/doc/auto/doc.md", 3), (f"{root}/two/deep/y.md", 2), (f"{root}/two/x.md", 1)]
    with pytest.raises(ValueError, match="No output"):
        require_output(output_folders(files.where("false"), str(root)), str(root))


# -- streams -----------------------------------------------------------------------


def run_stream(spark, folder, space, checkpoint):
    docs = document_stream(spark, str(folder), files_per_batch=2)
    start_workspace(docs, space, F.lit(STAMP), str(checkpoint)).awaitTermination()


def test_a_stream_converts_new_files_once_and_the_batch_run_finds_changes(spark, folder, tmp_path):
    space = workspace(spark, tmp_path)
    run_stream(spark, folder, space, tmp_path / "cp")
    assert space.status().first().asDict() == {"total": 5, "success": 4, "failed": 1}

    (folder / "sub" / "c.txt").write_bytes(b"changed in place")
    (folder / "late.txt").write_bytes(b"late")
    run_stream(spark, folder, space, tmp_path / "cp")
    assert space.status().first()["total"] == 6
    plan = actions(space.plan(inbox.scan(spark, str(folder))))
    assert plan["sub/c.txt"] == "Modified (re-conversion needed)"
    assert plan["late.txt"] == "Already converted"
    space.convert(inbox.scan(spark, str(folder)), F.lit(STAMP))
    assert space.status().first()["total"] == 7


def test_a_repeated_ledger_batch_changes_nothing(spark, folder, tmp_path):
    space = workspace(spark, tmp_path)
    space.convert(inbox.scan(spark, str(folder)), F.lit(STAMP))
    space.ledger.read().write.parquet(str(tmp_path / "rows"))
    other = Workspace(spark, str(tmp_path / "other"))
    for checkpoint in ("cp", "cp"):
        rows = spark.readStream.schema(space.ledger.read().schema).parquet(str(tmp_path / "rows"))
        start_ledger(rows, other.ledger, str(tmp_path / checkpoint)).awaitTermination()
    assert other.status().first().asDict() == space.status().first().asDict()
    stream = (tmp_path / "cp" / "metadata").read_text().splitlines()[0]
    other.ledger.append(space.ledger.read(), name=f"{stream}#0")
    assert other.status().first().asDict() == space.status().first().asDict()
    assert other.ledger.next_version() == 2


def test_exported_files_are_read_back_without_a_listing(spark, tmp_path):
    from catalog.queries import QUERIES
    from hashlib import sha256

    rows = [(1, "en", "x y%20#", "a"), (2, "en", "x y%20#", "b"), (3, "en", "x y%20#", None),
            (4, "de", "z", "d"), (4, "de", "z", "d"), (5, "en", "_hidden", "e")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(
        str(tmp_path / "documents.parquet"))

    def digest(text):
        return sha256(text.encode()).hexdigest()

    texts = QUERIES["markdown_sink"](spark, str(tmp_path))
    # the rest, empty and hidden files, is what a scan of the folder leaves out
    assert values(texts, "name", "content_hash") == sorted([
        ("x y%20#.md", digest("a")), ("x y%20#_1.md", digest("b")),
        ("z.md", digest("d")), ("z_1.md", digest("d"))])
    images = QUERIES["attachment_sink"](spark, str(tmp_path))
    assert values(images, "name", "content_hash") == sorted(
        (f"attachments/{digest(t)[:8]}/{n}.png", digest(t))
        for n, t in ((1, "a"), (2, "b"), (4, "d"), (5, "e")))
    for found in (texts, images):
        assert not [path for path in found.inputFiles() if not path.endswith(".parquet")]
