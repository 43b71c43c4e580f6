"""Columns over file paths, file names and content hashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters not allowed in file names, the cut, and the ending.
FORBIDDEN_CHARACTERS = r'[\\/:*?"<>|]'
NAME_LENGTH = 128
MARKDOWN_ENDING = ".md"

BASENAME = r"([^/]*)/*$"
SUFFIX = r"(?s)^.+(\.[^.]+)$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, BASENAME, 1)


def file_suffix(path: Column) -> Column:
    """Last suffix as written; ``''`` for dot files and names without one."""
    return F.regexp_extract(file_name(path), SUFFIX, 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.left(name, F.length(name) - F.length(file_suffix(path)))


def format_of(path: Column) -> Column:
    return F.lower(file_suffix(path))


def is_supported(fmt: Column, supported: Iterable[str]) -> Column:
    return fmt.isin(*[s.lower() for s in supported])


def unsupported_reason(path: Column) -> Column:
    return F.concat(F.lit("Unsupported format: "), file_suffix(path))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_prefix(file_hash: Column, length: int = 8) -> Column:
    return F.substring(file_hash, 1, length)


def markdown_name(stem: Column, title: Column | None = None) -> Column:
    """Output file name: the title if there is one, else the stem, made safe."""
    base = stem if title is None else F.coalesce(F.nullif(title, F.lit("")), stem)
    base = F.regexp_replace(base, r"(?U)^\s+|\s+$", "")
    base = F.regexp_replace(base, FORBIDDEN_CHARACTERS, "_")
    return F.concat(F.left(base, F.lit(NAME_LENGTH)), F.lit(MARKDOWN_ENDING))
