"""Best Markdown, unique names, digests, orphans, and the building blocks against skew."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import values
from quire.functions.epub import saved_names
from quire.operators import layout, skew


def files(spark, rows):
    return spark.createDataFrame(rows, "subdir string, md_file string, length long")


def best(spark, rows):
    found = layout.best_markdown(files(spark, rows), "subdir", "md_file", "length")
    return dict(values(found, "subdir", "md_file"))


def test_a_matching_name_wins_over_size(spark):
    rows = [("/o/My_Paper", f"/o/My_Paper/{n}.md", s)
            for n, s in (("other", 9), ("my_paper", 1), ("extra", 99))]
    assert best(spark, rows) == {"/o/My_Paper": "/o/My_Paper/my_paper.md"}


def test_without_a_match_the_largest_wins_then_the_first_path(spark):
    rows = [("/o/zz", "/o/zz/small.md", 1), ("/o/zz", "/o/zz/b.md", 100), ("/o/zz", "/o/zz/a.md", 100)]
    assert best(spark, rows) == {"/o/zz": "/o/zz/a.md"}


def test_empty_files_do_not_count(spark):
    assert best(spark, [("/o/d", "/o/d/d.md", 0), ("/o/d", "/o/d/x.md", 5), ("/o/e", "/o/e/e.md", 0)]) == {
        "/o/d": "/o/d/x.md"}


def test_image_files(spark):
    rows = [(f"/i/{n}",) for n in ("a.JPG", "b.webp", "c.svg", "d.txt", "e.tif", "png")]
    frame = spark.createDataFrame(rows, "path string")
    assert values(layout.image_files(frame, "path"), "path") == [
        ("/i/a.JPG",), ("/i/b.webp",), ("/i/e.tif",)]


def test_orphans(spark):
    outputs = spark.createDataFrame([("keep_me",), ("gone_1",), ("gone_2",)], "name string")
    keep = spark.createDataFrame([("keep_me",), ("other",)], "name string")
    assert values(layout.orphan_outputs(outputs, keep, "name"), "name") == [("gone_1",), ("gone_2",)]


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_name_collisions(spark, hot_rows):
    rows = [(f"/{i}", "same.md" if i < 40 else f"{i}.md") for i in range(50)]
    frame = spark.createDataFrame(rows, "path string, md_filename string")
    flagged = layout.flag_name_collisions(frame, hot_rows)
    assert flagged.where("shared_name").count() == 40 and flagged.count() == 50


# -- names -------------------------------------------------------------------------


def deduped(spark, names_by_group, rows_per_bucket):
    rows = [(g, n, i) for g, names in names_by_group.items() for i, n in enumerate(names)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, n string, pos long")
    done = layout.dedupe_names(frame, "g", "n", "pos", rows_per_bucket=rows_per_bucket)
    result = {}
    for row in done.orderBy("pos").collect():
        result.setdefault(row["g"], []).append(row["saved_name"])
    return result


def test_copies_get_suffixes_in_order(spark):
    names = {"d1": ["a.png", "b.png", "a.png", "a.png"], "d2": ["a.png", "none", "none", ".x", ".x"]}
    expected = {
        "d1": ["a.png", "b.png", "a_1.png", "a_2.png"],
        "d2": ["a.png", "none", "none_1", ".x", ".x_1"]}
    assert deduped(spark, names, 1_000_000) == expected
    assert deduped(spark, names, 1) == expected


@pytest.mark.parametrize("names, saved", [
    (["a.png", "a_1.png", "a.png"], ["a.png", "a_1.png", "a_2.png"]),
    (["a.png", "a.png", "a_1.png"], ["a.png", "a_1.png", "a_1_1.png"]),
    (["a_1.png", "a.png", "a.png", "a_1.png"], ["a_1.png", "a.png", "a_2.png", "a_1_1.png"]),
    (["a_01.png", "a.png", "a.png"], ["a_01.png", "a.png", "a_1.png"])])
def test_suffixed_names_that_already_exist(spark, names, saved):
    assert saved_names(names) == saved
    assert deduped(spark, {"d": names}, 1_000_000) == {"d": saved}


@pytest.mark.parametrize("seed", range(3))
def test_names_as_one_after_the_other_would_choose(spark, seed):
    draw = random.Random(seed)
    pool = ["a.png", "a_1.png", "a_2.png", "a_3.png", "a_1_1.png", "a_1_2.png", "a_2_1.png", "b"]
    names = {f"d{k}": [draw.choice(pool) for _ in range(draw.randint(1, 25))] for k in range(25)}
    expected = {group: saved_names(given) for group, given in names.items()}
    assert all(len(set(given)) == len(given) for given in expected.values())
    assert deduped(spark, names, 20) == expected


# -- digests -----------------------------------------------------------------------


def digest(files):
    """The definition, in plain Python."""
    sums, n = [0] * 8, 0
    for path, name, size in files:
        found = hashlib.sha256(f"{path}\0{name}\0{size}".encode()).digest()
        sums = [s + int.from_bytes(found[4 * i:4 * i + 4]) for i, s in enumerate(sums)]
        n += 1
    return hashlib.sha256(",".join(map(str, [*sums, n])).encode()).hexdigest()


def fingerprints(spark, rows):
    frame = spark.createDataFrame(rows, "g string, path string, name string, size long")
    return dict(values(layout.group_fingerprint(frame, "g", "path", "name", "size"),
                       "g", "fingerprint"))


def test_the_digest_of_a_group_does_not_depend_on_order(spark):
    files = [("b/x.md", "x.md", 3), ("b.md", "b.md", 12), ("a/z.md", "z.md", 1)]
    rows = [("g", *f) for f in files] + [("h", "q", "q", 0)]
    expected = {"g": digest(files), "h": digest([("q", "q", 0)])}
    assert fingerprints(spark, rows) == fingerprints(spark, rows[::-1]) == expected


@pytest.mark.parametrize("n", [4096, 4097, 10_000])
def test_groups_of_all_sizes_have_one_definition(spark, n):
    files = [(f"{i}.md", f"{i}.md", i) for i in range(n)]
    assert fingerprints(spark, [("g", *f) for f in files]) == {"g": digest(files)}


# -- building blocks ---------------------------------------------------------------


@pytest.mark.parametrize("rows_per_bucket", [7, 50, 1_000_000])
def test_running_totals_over_a_hot_key(spark, rows_per_bucket):
    draw = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 11}", i * i, draw.randint(-5, 9)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, o long, v long")
    expected, sums = [], {}
    for k, o, v in sorted(rows, key=lambda row: row[1]):
        sums[k] = sums.get(k, 0) + v
        expected.append((k, o, v, sums[k]))
    total = skew.running_total(frame, ["k"], "o", F.col("v"), "t", rows_per_bucket)
    assert values(total, "k", "o", "v", "t") == sorted(expected, key=repr)


def test_no_window_task_holds_a_hot_key(spark):
    frame = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    total = skew.number_within(frame, ["k"], "o", "n", 100)
    text = total._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^)]*)\)", text)
    assert all("_bucket" in window for window in windows) and windows
    assert 8 <= len(skew.quantile_cuts(frame, "o", 100)) <= 12


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_a_plain_join(spark, how):
    left = spark.range(600).select(
        F.when(F.col("id") < 300, "hot").when(F.col("id") < 350, None)
        .otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("400", 3), (None, 4)], "k string, w int")
    plain = left.join(right, "k", how)
    spread = skew.lookup_join(left, right, ["k"], how, "v", hot_rows=40)
    assert skew.hot_keys(left, ["k"], 40) and values(spread, *plain.columns) == values(
        plain, *plain.columns)


def test_only_large_keys_are_hot_and_their_number_is_bounded(spark, monkeypatch):
    frame = spark.range(1000).select((F.col("id") % 500).alias("k"))
    assert skew.hot_keys(frame, ["k"], 2) == []
    skewed = frame.unionByName(spark.range(1000).select(F.lit(7).cast("long").alias("k")))
    assert skew.hot_keys(skewed, ["k"], 100) == [(7,)]
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    assert len(skew.hot_keys(skewed, ["k"], 1)) == 3
    # keys beyond the bound are joined as usual, so nothing is lost
    right = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    joined = skew.lookup_join(skewed, right, ["k"], "inner", "k", hot_rows=1)
    assert joined.count() == 2000


def test_orphans_are_removed_and_counted(spark, tmp_path):
    from quire.sources.files import remove_paths
    from quire.sources.output_tree import remove_orphans

    for name in ("keep me/a.md", "old 1/auto/b.md", "old 1/images/b.png", "old 2/c.md", "d.md"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("x")
    keep = spark.createDataFrame([("keep me",), ("never there",), (None,)], "name string")
    removed = remove_orphans(spark, str(tmp_path / "tree"), keep)
    assert sorted(p.name for p in (tmp_path / "tree").iterdir()) == ["d.md", "keep me"]
    assert removed.where("removed").count() == 2
    assert remove_orphans(spark, str(tmp_path / "tree"), keep).count() == 0

    paths = [(str(tmp_path / "tree" / "d.md"),), (str(tmp_path / "none"),), (None,)]
    found = remove_paths(spark.createDataFrame(paths, "path string")).collect()
    assert sorted((r["path"] or "", r["removed"]) for r in found) == sorted(
        [(paths[0][0], True), (paths[1][0], True), ("", False)])
    assert sorted(p.name for p in (tmp_path / "tree").iterdir()) == ["keep me"]
