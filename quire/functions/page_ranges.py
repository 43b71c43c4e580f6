"""Columns for page ranges such as ``3-5`` (1-based, inclusive)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*\+?[0-9]+\s*$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("int"))


def page_range(text: Column) -> Column:
    """``struct(start_page, end_page, page_range_error)``, pages 0-based.

    An empty text means the whole document. A malformed range, or one outside
    ``1 <= start <= end``, gives null pages and an error for that row only.
    """
    trimmed = F.trim(text)
    start = _number(F.substring_index(trimmed, "-", 1))
    end = _number(F.regexp_replace(trimmed, r"^[^-]*-", ""))
    wanted = F.coalesce(trimmed, F.lit("")) != ""
    valid = F.coalesce((start >= 1) & (end >= start), F.lit(False))
    return F.struct(
        F.when(wanted & valid, start - 1).alias("start_page"),
        F.when(wanted & valid, end - 1).alias("end_page"),
        F.when(wanted & ~valid, F.concat(F.lit("Invalid page range: "), text)).alias(
            "page_range_error"
        ),
    )


def page_selected(page: Column, start: Column, end: Column) -> Column:
    """Row filter for tables with one row per page; null bounds keep everything."""
    return (start.isNull() | (page >= start)) & (end.isNull() | (page <= end))


def slice_pages(text: Column, start: Column, end: Column, separator: str = "\f") -> Column:
    """Keep pages ``start..end`` of a text whose pages are parted by ``separator``."""
    pages = F.split(text, _literal_pattern(separator), -1)
    first = F.coalesce(start, F.lit(0))
    last = F.coalesce(end, F.size(pages) - 1)
    kept = F.slice(pages, first + 1, F.greatest(last - first + 1, F.lit(0)))
    return F.array_join(kept, separator)


def _literal_pattern(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)
