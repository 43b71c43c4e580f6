"""Columns that read and rewrite the image links of a Markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.names import file_name

# The shapes of an image link.
IMAGE_LINK = r"!\[([^\]]*)\]\(([^)]+)\)"
LOCAL_IMAGE_LINK = r"(!\[[^\]]*\])\((?:\./)?images/([^)]+)\)"
EXTERNAL_PREFIXES = ("http://", "https://")

_SPLIT = r"!\[[^\]]*\]\([^)]+\)"


def is_external(ref: Column) -> Column:
    http, https = (ref.startswith(p) for p in EXTERNAL_PREFIXES)
    return http | https


def image_refs(md: Column) -> Column:
    """All image references of a text, in order, external ones included."""
    return F.regexp_extract_all(md, F.lit(IMAGE_LINK), F.lit(2))


def local_image_refs(md: Column) -> Column:
    return F.filter(image_refs(md), lambda ref: ~is_external(ref))


def rewrite_local_links(md: Column, prefix: Column) -> Column:
    """Point ``images/x`` and ``./images/x`` links at ``<prefix>/x``."""
    literal = F.regexp_replace(prefix, r"([\\$])", r"\\$1")
    return F.regexp_replace(
        md, F.lit(LOCAL_IMAGE_LINK), F.concat(F.lit("$1("), literal, F.lit("/$2)"))
    )


def rewrite_mapped_links(
    md: Column, prefix: Column, name_map: Column, keep_external: bool = False
) -> Column:
    """Point every image link at ``<prefix>/<saved name>``.

    The saved name is looked up by the whole reference, then by its base name; an
    unknown image keeps its base name.
    """
    # text and links side by side, so that the text is searched once and not per link
    parts = F.arrays_zip(
        F.split(md, _SPLIT, -1).alias("text"),
        F.regexp_extract_all(md, F.lit(IMAGE_LINK), F.lit(1)).alias("alt"),
        image_refs(md).alias("ref"))

    def saved(ref: Column) -> Column:
        base = file_name(ref)
        return F.coalesce(
            F.nullif(name_map[ref], F.lit("")), F.nullif(name_map[base], F.lit("")), base
        )

    def target(ref: Column) -> Column:
        moved = F.concat(prefix, F.lit("/"), saved(ref))
        return F.when(is_external(ref), ref).otherwise(moved) if keep_external else moved

    def rebuilt(part: Column) -> Column:
        link = F.concat(F.lit("!["), part["alt"], F.lit("]("), target(part["ref"]), F.lit(")"))
        return F.concat(part["text"], F.when(part["ref"].isNotNull(), link).otherwise(F.lit("")))

    return F.array_join(F.transform(parts, rebuilt), "")
