"""Output layout: which Markdown file to keep, file names, group digests, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.names import file_name, file_stem, file_suffix
from quire.operators.skew import (
    HOT_ROWS,
    cut_lineage,
    lookup_join,
    number_within,
    running_total,
)
from quire.options import IMAGE_EXTENSIONS


def best_markdown(files: DataFrame, group: str, path: str, size: str) -> DataFrame:
    """One file per group: empty files are out; a name that contains the group's name, or
    is contained in it, wins; then the largest file, then the first path.

    A minimum over a struct, so a group of any size is reduced before the shuffle.
    """
    stem, wanted = F.lower(file_stem(F.col(path))), F.lower(file_name(F.col(group)))
    matches = F.contains(stem, wanted) | F.contains(wanted, stem)
    rank = F.struct(
        (~matches).alias("other"), (-F.col(size)).alias("small"), F.col(path).alias("path"))
    best = files.where(F.col(size) > 0).groupBy(group).agg(F.min(rank).alias("best"))
    return best.select(
        group, F.col("best.path").alias(path), (-F.col("best.small")).alias(size),
        (~F.col("best.other")).alias("name_matches"))


def image_files(files: DataFrame, path: str) -> DataFrame:
    """The files of the image types that are stored next to the Markdown."""
    return files.where(F.lower(file_suffix(F.col(path))).isin(*IMAGE_EXTENSIONS))


def orphan_outputs(outputs: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Outputs that nobody keeps. Any one key may have a large part of the outputs."""
    spread_by = next((c for c in outputs.columns if c != key), key)
    return lookup_join(outputs, keep.select(key).distinct(), [key], "left_anti", spread_by)


def flag_name_collisions(results: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``shared_name``: another result has the same ``md_filename``."""
    counts = results.groupBy("md_filename").agg((F.count(F.lit(1)) > 1).alias("shared_name"))
    return lookup_join(results, counts, ["md_filename"], "left", "path", hot_rows)


# -- file names without collisions ---------------------------------------------


def dedupe_names(
    files: DataFrame, group: str, name: str, pos: str, out: str = "saved_name",
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """Names that are unique within a group: in order of ``pos``, a taken name gets the
    lowest free suffix ``_1``, ``_2``… ``group`` is never null; ``pos`` is unique in it.

    Usually the suffix is the number of the copy, less one. It differs only if a suffixed
    name also comes as a name of its own in the group (``a.png`` twice and ``a_1.png``);
    those cases are settled in ``_settle``.
    """
    numbered = number_within(files, [group, name], pos, "_copy", rows_per_bucket)
    families = files.groupBy(group, name).agg(F.min(pos).alias("_first"))
    clashes = _clashes(families, group, name)
    if clashes.isEmpty():
        chosen = numbered.withColumn("_suffix", F.col("_copy") - 1)
    else:
        numbered = cut_lineage(numbered, "numbered")
        settled = _settle(numbered, clashes, group, name, pos, rows_per_bucket)
        chosen = _suffixes(numbered, settled, group, name, pos, rows_per_bucket)
    suffixed = _suffixed(F.col(name), F.col("_suffix"))
    final = F.when(F.col("_suffix") == 0, F.col(name)).otherwise(suffixed)
    return chosen.withColumn(out, final).select(*files.columns, out)


def _suffixed(name: Column, suffix: Column) -> Column:
    return F.concat(file_stem(name), F.lit("_"), suffix.cast("string"), file_suffix(name))


def _clashes(families: DataFrame, group: str, name: str) -> DataFrame:
    """Names of a group that could also be made from another name of it by a suffix."""
    parts = r"(?s)^(.*)_([1-9][0-9]{0,17})$"
    stem = file_stem(F.col(name))
    children = families.where(stem.rlike(parts)).select(
        group,
        F.concat(F.regexp_extract(stem, parts, 1), file_suffix(F.col(name))).alias("_parent"),
        F.col(name).alias("_child"),
        F.regexp_extract(stem, parts, 2).cast("long").alias("_j"),
        "_first",
    )
    parents = families.select(group, F.col(name).alias("_parent"))
    return children.join(parents, [group, "_parent"], "left_semi")


def _settle(
    numbered: DataFrame, clashes: DataFrame, group: str, name: str, pos: str, rows_per_bucket: int
) -> DataFrame:
    """Who gets a name that two families want: its first own file, or a copy of the parent.

    Whoever comes first. Which copy would take suffix j depends on how many lower suffixes
    were already gone, so the answers are repeated until none changes; each depends only on
    lower suffixes and on the parent, hence the end is reached and is the only one.
    """
    copies = numbered.select(
        group, F.col(name).alias("_parent"), F.col("_copy"), F.col(pos).alias("_copy_pos"))
    state = cut_lineage(clashes.withColumns({
        "_gone": F.lit(False), "_taken": F.lit(False)}), "clashes")
    while True:
        fresh = cut_lineage(_ask_again(state, copies, group, rows_per_bucket), "clashes")
        changed = (F.col("_gone") != F.col("_old_gone")) | (F.col("_taken") != F.col("_old_taken"))
        state = fresh.drop("_old_gone", "_old_taken")
        if fresh.where(changed).isEmpty():
            return state


def _ask_again(
    state: DataFrame, copies: DataFrame, group: str, rows_per_bucket: int
) -> DataFrame:
    gone = F.col("_gone").cast("long")
    counted = running_total(
        state, [group, "_parent"], "_j", gone, "_total", rows_per_bucket)
    lost = state.where("_taken").select(
        group, F.col("_child").alias("_parent"), F.lit(1).alias("_lost"))
    turn = F.col("_j") - (F.col("_total") - gone)
    asked = counted.join(lost, [group, "_parent"], "left").select(
        group, "_parent", "_child", "_j", "_first", turn.alias("_turn"),
        F.col("_gone").alias("_old_gone"), F.col("_taken").alias("_old_taken"),
        # the parent's own first file keeps its name unless that was taken
        (turn + 1 - F.coalesce("_lost", F.lit(0))).alias("_copy"))
    answered = asked.join(copies, [group, "_parent", "_copy"], "left")
    reached = F.col("_copy_pos").isNotNull()
    return answered.select(
        group, "_parent", "_child", "_j", "_first", "_turn", "_old_gone", "_old_taken",
        (reached & (F.col("_first") < F.col("_copy_pos"))).alias("_gone"),
        (reached & (F.col("_first") >= F.col("_copy_pos"))).alias("_taken"))


def _suffixes(
    numbered: DataFrame, settled: DataFrame, group: str, name: str, pos: str,
    rows_per_bucket: int,
) -> DataFrame:
    """The suffix per file: its number among the copies, plus the suffixes gone before it."""
    lost = settled.where("_taken").select(group, F.col("_child").alias(name), F.lit(1).alias("_lost"))
    number = (F.col("_copy") - 1 + F.coalesce("_lost", F.lit(0))).alias("_number")
    files = lookup_join(numbered, lost, [group, name], "left", pos).select(
        *numbered.columns, number)
    gaps = settled.where("_gone").select(
        group, F.col("_parent").alias(name), F.col("_turn").alias("_number"),
        F.lit(1).cast("long").alias("_gap"))
    both = files.withColumn("_gap", F.lit(0).cast("long")).unionByName(
        gaps, allowMissingColumns=True)
    # gaps sort before the file of the same number; several gaps may share a number
    placed = both.withColumn(
        "_place", F.col("_number") * 2 + F.when(F.col("_gap") == 1, 0).otherwise(1))
    summed = running_total(placed, [group, name], "_place", F.col("_gap"), "_gaps", rows_per_bucket)
    own = F.col("_number") == 0
    return summed.where(F.col("_gap") == 0).withColumn(
        "_suffix", F.when(own, F.lit(0)).otherwise(F.col("_number") + F.col("_gaps")))


# -- digest of a group of files --------------------------------------------------


def group_fingerprint(
    files: DataFrame, group: str, path: str, name: str, size: str
) -> DataFrame:
    """A digest of the paths, names and sizes of a group's files, in whatever order.

    Each file has a SHA-256 of its path, name and size, parted by NUL; give paths below the
    group, so that a group that was moved keeps its digest. The eight 32-bit words of those
    digests are summed over the group, and the sums and the number of files are digested.
    It is one definition for groups of all sizes, and sums are partial before the shuffle.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (path, name, size)]
    digest = F.sha2(F.concat_ws("\0", *text), 256)
    words = [
        F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
        for i in range(8)]
    summed = files.select(group, digest.alias("_digest")).groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)])
    parts = [F.col(c).cast("string") for c in (*(f"_w{i}" for i in range(8)), "_n")]
    return summed.select(group, F.sha2(F.concat_ws(",", *parts), 256).alias("fingerprint"))
