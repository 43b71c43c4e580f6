"""Documents converted by an installed program."""

import stat
import sys

import pytest

from helpers import docs, values
from quire.functions.external import command_converter
from quire.operators.convert import attachments, convert

ENGINE = """#!{python}
import pathlib, sys, time
source, out = pathlib.Path(sys.argv[1]), pathlib.Path(sys.argv[2])
text = source.read_text()
if text == "crash":
    print("bad input", file=sys.stderr); sys.exit(3)
if text == "slow":
    time.sleep(30)
if text == "nothing":
    sys.exit(0)
folder = out / source.stem / "auto"
(folder / "images").mkdir(parents=True)
(folder / "other.md").write_text("x" * 500)
(folder / "document.md").write_text("" if text == "empty" else "# " + text + "\\n![p](images/p.png)")
(folder / "images" / "p.png").write_bytes(b"png")
(folder / "images" / "notes.txt").write_bytes(b"no image")
if text == "empty":
    (folder / "other.md").write_text("")
"""


@pytest.fixture
def engine(tmp_path):
    path = tmp_path / "engine"
    path.write_text(ENGINE.format(python=sys.executable))
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


def test_program_output_becomes_rows(spark, engine):
    convert_pdf = command_converter([engine, "{input}", "{output}"], ".pdf", timeout=10)
    texts = {"a": "Hello", "b": "crash", "c": "nothing", "d": "empty", "e": "slow"}
    frame = docs(spark, {f"/in/{n}.pdf": text.encode() for n, text in texts.items()})
    done = convert(frame, {".pdf": convert_pdf})
    rows = {row["path"]: row for row in done.collect()}
    good = rows["/in/a.pdf"]
    assert good["md"] == f"# Hello\n![p](attachments/{good['file_hash'][:8]}/p.png)"
    assert (good["md_filename"], good["image_count"]) == ("a.md", 1)
    assert rows["/in/b.pdf"]["error"].endswith("failed (exit code 3): bad input")
    assert rows["/in/c.pdf"]["error"] == "No output subdirectories found"
    assert rows["/in/d.pdf"]["error"] == "No valid markdown files found"
    assert rows["/in/e.pdf"]["error"].endswith("timed out after 10s")
    assert values(attachments(done), "name") == [("p.png",)]


def test_a_missing_program_is_an_error_of_the_row(spark):
    run = command_converter(["/no/such/program", "{input}"], ".pdf")
    row = convert(docs(spark, {"/in/a.pdf": b"x"}), {".pdf": run}).first()
    assert (row["status"], row["error"]) == ("failed", "command not found: /no/such/program")
