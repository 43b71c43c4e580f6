"""Large JSON objects in blocks, against the reader of one task and plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import values
from quire.schemas import LEDGER
from quire.sources import json_blocks
from quire.sources.manifest import read_manifest

BLOCKS = (1, 7, 64, 1000, 1 << 20)


def entry(i, **more):
    return {"source_path": f"/in/{i}", "source_filename": f"{i}.pdf", "source_size": i,
            "output_md": "", "output_attachments": "", "format": ".pdf",
            "converted_at": "2024-05-06T07:08:09.123456+00:00", "status": "success",
            "error": None} | more


NASTY = [
    'quote " and backslash \\', "\\\\", '\\" {[', "}}]],,", "é\U0001f600 ", "a" * 300,
    "\\" * 150, '"files": {', "", "tab\t\n"]


def write(path, files, indent=None, **more):
    text = json.dumps({"version": "1.0"} | more | {"files": files}, indent=indent,
                      ensure_ascii=indent is None)
    path.write_text(text, "utf-8")


def check(spark, path, block):
    blocks = read_manifest(spark, str(path), in_blocks=True, block_bytes=block)
    whole = read_manifest(spark, str(path), in_blocks=False)
    assert values(blocks, *LEDGER.fieldNames()) == values(whole, *LEDGER.fieldNames())
    return blocks.count()


@pytest.mark.parametrize("block", BLOCKS[1:])
def test_rows_are_those_of_one_task(spark, tmp_path, block):
    files = {f"h{i}": entry(i, error=text, source_path=text) for i, text in enumerate(NASTY)}
    (tmp_path / "m").mkdir()
    write(tmp_path / "m" / "indented.json", files, indent=2)
    write(tmp_path / "m" / "plain.json", files)
    assert check(spark, tmp_path / "m", block) == 2 * len(NASTY)


def test_other_members_are_not_records(spark, tmp_path):
    path = tmp_path / "m.json"
    write(path, {"a": entry(1), "b": None}, notes={"files": {"x": 1}, "h": entry(2)},
          list=[1, {"a": [2, 3]}], text="{[\"", number=1, none=None)
    assert check(spark, path, 16) == 2
    write(path, {})
    assert check(spark, path, 5) == 0
    path.write_text('{"version": "1.0"}')
    assert check(spark, path, 5) == 0
    path.write_text('{"files": null}')
    assert check(spark, path, 5) == 0


@pytest.mark.parametrize("text", [
    "{", '{"version": "1.0", "files": {', '{"files": {"a": {"status": "x"}}',
    '{"files": {"a": {"status": "x}}}', '{"files": {"a": {"status": "x"]}}}',
    '{"files": {"a": {"status" "x"}}}', '{"files": {"a": {"status": "x"},, "b": {}}}',
    '{"files": {"a": {"status": "x"}, }}', '{"files": {}}}', "[]x", '{"files" {"a": {}}}'])
def test_broken_manifests_fail(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception):
        read_manifest(spark, str(path), in_blocks=True, block_bytes=9).collect()


def test_large_files_are_read_in_blocks_by_themselves(spark, tmp_path, monkeypatch):
    from quire.sources import manifest
    write(tmp_path / "m.json", {"a": entry(1), "b": entry(2)})
    sizes = []
    real = manifest._entries_in_blocks
    monkeypatch.setattr(manifest, "_entries_in_blocks", lambda files, size: sizes.append(
        size) or real(files, size))
    assert read_manifest(spark, str(tmp_path / "m.json")).count() == 2 and not sizes
    monkeypatch.setattr(manifest, "LARGE", 10)
    assert read_manifest(spark, str(tmp_path / "m.json")).count() == 2 and len(sizes) == 1


def test_states_at_block_starts(spark, tmp_path):
    draw = random.Random(3)
    text = json.dumps({"files": {str(i): {"s": draw.choice(NASTY), "n": [[1], {"x": "]"}]}
                                 for i in range(40)}}).encode()
    path = tmp_path / "x.json"
    path.write_bytes(text)
    file = json_blocks._File(str(path))
    in_string, escaped, depth, states = False, False, 0, []
    for byte in text:
        states.append((in_string, depth))
        if in_string:
            if escaped:
                escaped = False
            elif byte == 0x5C:
                escaped = True
            elif byte == 0x22:
                in_string = False
        elif byte == 0x22:
            in_string = True
        else:
            depth += (byte in b"{[") - (byte in b"}]")
    for size in (1, 5, 33):
        state, deep = False, 0
        for start in range(0, len(text), size):
            assert (state, deep) == states[start]
            raw, _, upto = json_blocks._marks(file.read(start, size), file.escapes(start))
            odd = (upto + state) % 2 == 1
            deep += int(json_blocks._steps(raw)[~odd].sum())
            state = bool(odd[-1])


def test_many_tasks_read_one_file(spark, tmp_path, monkeypatch):
    written, real = {}, json_blocks.cut_lineage
    monkeypatch.setattr(json_blocks, "cut_lineage", lambda df, label: written.setdefault(
        label, real(df, label)))
    write(tmp_path / "m.json", {f"h{i}": entry(i, error="x" * 500) for i in range(3000)}, indent=1)
    rows = read_manifest(spark, str(tmp_path / "m.json"), in_blocks=True, block_bytes=1 << 16)
    assert rows.count() == 3000
    tasks = written["json-members"].select(F.input_file_name()).distinct().count()
    assert tasks == spark.sparkContext.defaultParallelism
