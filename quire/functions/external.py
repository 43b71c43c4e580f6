"""A converter that calls an installed program, for formats parsed outside Python.

This is the per-row helper of the Python stage: one document in, its Markdown and images
out. Its files live in a private folder of the task and are gone when it returns.
"""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path

from quire.options import DOCUMENT_TIMEOUT, IMAGE_EXTENSIONS

INPUT, OUTPUT = "{input}", "{output}"


def command_converter(
    command: Sequence[str], ending: str, timeout: float = DOCUMENT_TIMEOUT
) -> Callable[[bytes], dict]:
    """``command`` is run per document, with ``{input}`` and ``{output}`` replaced by the
    document's file (named with ``ending``) and an empty folder. The program writes a
    folder with a Markdown file and perhaps an ``images`` folder, anywhere below."""

    def convert(content: bytes) -> dict:
        with tempfile.TemporaryDirectory() as private:
            source, target = Path(private, "document" + ending), Path(private, "out")
            source.write_bytes(content)
            target.mkdir()
            places = {INPUT: str(source), OUTPUT: str(target)}
            _run([places.get(part, part) for part in command], timeout)
            return _collect(target)

    return convert


def _run(arguments: list[str], timeout: float) -> None:
    program = arguments[0]
    try:
        done = subprocess.run(arguments, capture_output=True, text=True, timeout=timeout)
    except FileNotFoundError:
        raise RuntimeError(f"command not found: {program}") from None
    except subprocess.TimeoutExpired:
        raise RuntimeError(f"{program} timed out after {timeout}s") from None
    if done.returncode:
        raise RuntimeError(f"{program} failed (exit code {done.returncode}): {done.stderr.strip()}")


def _collect(target: Path) -> dict:
    folders = sorted(path for path in target.iterdir() if path.is_dir())
    if not folders:
        raise RuntimeError("No output subdirectories found")
    text = _best(folders[0])
    pictures = []
    for folder in sorted(folders[0].rglob("images")):
        files = [path for path in sorted(folder.iterdir()) if path.is_file()]
        if files:
            pictures = [path for path in files if path.suffix.lower() in IMAGE_EXTENSIONS]
            break
    return {"md": text.read_text("utf-8"),
            "images": [(path.name, path.read_bytes()) for path in pictures]}


def _best(folder: Path) -> Path:
    """As ``operators.layout.best_markdown`` chooses within a group."""
    wanted = folder.name.lower()
    sized = [(path, path.stat().st_size) for path in sorted(folder.rglob("*.md")) if path.is_file()]
    sized = [(path, size) for path, size in sized if size]
    if not sized:
        raise RuntimeError("No valid markdown files found")

    def rank(entry: tuple[Path, int]) -> tuple:
        stem = entry[0].stem.lower()
        return not (wanted in stem or stem in wanted), -entry[1], str(entry[0])

    return min(sized, key=rank)[0]
