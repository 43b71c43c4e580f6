"""The n-gram join against brute force."""

import random
import re

import numpy as np
import pytest

from quire.llm import jaccard, sketches, trie

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + words]) for i in range(len(found) - words + 1)}


def expected(rows, words, part, whole=100):
    sets = [(doc_id, grams(text, words)) for doc_id, text in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and whole * len(a & b) >= part * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        r = find(i)
        least[r] = min(least.get(r, doc_id), doc_id)
    return sorted((doc_id, len(s), least[find(i)]) for i, (doc_id, s) in enumerate(sets))


def result(spark, rows, words=3, part=90):
    frame = spark.createDataFrame(rows, DOCS)
    found = jaccard.near_duplicates(frame, words, part)
    return sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id").collect()))


def corpus(seed):
    draw = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(6):
        words = [draw.choice(pool) for _ in range(draw.choice([2, 3, 30, 90]))]
        for _ in range(draw.choice([1, 2, 25])):
            copy = list(words)
            for _ in range(draw.choice([0, 0, 1, 2])):
                copy[draw.randrange(len(copy))] = draw.choice(pool)
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one"),
                   (len(rows) + 3, "ONE"), (0, rows[0][1])]


@pytest.mark.parametrize("seed, words, part", [(1, 3, 90), (2, 5, 80)])
def test_components_are_those_of_all_pairs(spark, seed, words, part):
    rows = corpus(seed)
    assert result(spark, rows, words, part) == expected(rows, words, part)


def test_large_groups_in_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 5)
    rows = corpus(3)
    assert result(spark, rows, 3, 90) == expected(rows, 3, 90)


@pytest.mark.parametrize("seed, words, part", [(5, 3, 90), (6, 5, 80)])
def test_sets_of_unequal_sizes_meet_at_late_grams(spark, seed, words, part):
    """Copies with words cut off or put on, up to and beyond what the threshold allows."""
    draw = random.Random(seed)
    rows = []
    for base in range(5):
        text = [f"b{base}w{i}" for i in range(draw.choice([25, 60, 110]))]
        for _ in range(14):
            cut, put = draw.randint(0, len(text) // 2), draw.randint(0, len(text) // 4)
            copy = text[cut:] + [f"n{draw.randrange(9)}" for _ in range(put)]
            rows.append((len(rows), " ".join(copy)))
    want = expected(rows, words, part)
    assert 5 < len({component for *_, component in want}) < len(rows)
    assert result(spark, rows, words, part) == want


def all_links(rows, words, part, whole=100):
    sets = [frozenset(grams(text, words)) for _, text in rows]
    links = {s: sum(1 for t in {*sets} if t and t != s and whole * len(s & t) >= part * len(s | t))
             for s in {*sets} if s}
    least = {}
    for (doc_id, _), s in zip(rows, sets):
        least[s] = min(least.get(s, doc_id), doc_id)
    return sorted((doc_id, least[s] if s else doc_id, links.get(s, 0))
                  for (doc_id, _), s in zip(rows, sets))


@pytest.mark.parametrize("chunk", [2, 512])
def test_every_link_between_different_sets_is_counted(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    draw = random.Random(2)
    rows = corpus(4)
    words = [f"v{i}" for i in range(120)]
    for _ in range(30):
        copy = list(words)
        copy[0], copy[draw.randrange(1, 120)] = f"y{draw.randrange(20)}", "x"
        rows.append((len(rows) + 100, " ".join(copy)))
    found = jaccard.near_links(spark.createDataFrame(rows, DOCS), 3, 90).collect()
    want = all_links(rows, 3, 90)
    assert max(n for *_, n in want) > 5
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == want
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == expected(
        rows, 3, 90)


def test_no_rows_give_none(spark):
    assert result(spark, []) == []


def test_one_of_each_group_stays_with_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "x"), (1, text, "y"), (1, text, "y"), (2, None, "z"), (2, None, "z"),
            (9, "another text altogether", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = jaccard.keep_first(frame)
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(
        [(1, text, "y"), (2, None, "z"), (2, None, "z"), (9, "another text altogether", "n")],
        key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_the_trie_connects_what_all_pairs_connect(seed):
    draw = random.Random(seed)
    sets = []
    for _ in range(draw.randint(1, 30)):
        if sets and draw.random() < 0.7:
            near = set(draw.choice(sets)) ^ {draw.randrange(40) for _ in range(draw.randint(0, 3))}
        else:
            near = {draw.randrange(40) for _ in range(draw.randint(0, 25))}
        sets.append(sorted(near))
    arrays = [np.array(s, np.uint64) for s in sets]

    def joined(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return [min(i for i in range(len(sets)) if root[i] == root[k]) for k in range(len(sets))]

    everything = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j]
        and 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})]
    some = [i for i, s in enumerate(sets) if s]
    found = trie.links([arrays[i] for i in some], 80, 100)
    assert joined((some[a], some[b]) for a, b in found) == joined(everything)


@pytest.mark.parametrize("seed", range(20))
def test_the_trie_counts_all_pairs(seed):
    draw = random.Random(seed)
    sets = {frozenset({1, 2})}
    for _ in range(draw.randint(0, 40)):
        sets.add(frozenset(draw.choice(sorted(map(sorted, sets)))) ^ frozenset(
            draw.randrange(40) for _ in range(draw.randint(0, 4))))
    sets = [s for s in sets if s]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    probes = [i for i in range(len(sets)) if draw.random() < 0.4]
    for some in (None, probes, [], [*range(len(sets))]):
        want = [sum(100 * len(s & t) >= 80 * len(s | t) for j, t in enumerate(sets)
                    if i != j and (some is None or (i in some) != (j in some)))
                for i, s in enumerate(sets)]
        assert trie.link_counts(arrays, 80, 100, some).tolist() == want


@pytest.mark.parametrize("part", [80, 90])
@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_a_signature(part, seed):
    draw = np.random.default_rng(seed)
    for _ in range(300):
        n = int(draw.choice([1, 2, 3, 5, 9, 14, 40, 200, 900]))
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([
            a[draw.random(len(a)) > draw.choice([0, 0.05, 0.1])],
            draw.integers(0, 2**63, int(draw.integers(0, max(2, n // 8)))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= part * (len(a) + len(b) - shared):
            assert np.intersect1d(
                jaccard.segment_signatures(a, part, 100),
                jaccard.segment_signatures(b, part, 100)).size


def test_large_groups_cut_by_sketches_lose_no_link(spark, monkeypatch):
    """Sizes of several classes, each with several chunks of sketches."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 4)
    monkeypatch.setattr(jaccard, "SKETCH_SETS", 3)
    draw = random.Random(8)
    text = [f"w{i}" for i in range(160)]
    rows = []
    for _ in range(90):
        copy = text[:draw.randint(40, 160)]
        for _ in range(draw.choice([0, 1, 4])):
            copy[draw.randrange(len(copy))] = f"n{draw.randrange(99)}"
        rows.append((len(rows), " ".join(copy)))
    for part in (80, 90):
        want = expected(rows, 3, part)
        assert 1 < len({component for *_, component in want}) < len(rows)
        assert result(spark, rows, 3, part) == want


def test_texts_that_share_passages_are_not_all_compared(spark, monkeypatch):
    """Different texts with equal segments, and few pairs of them that are similar: only the
    n-grams of those meet. All slots count alike, as in a corpus with far more n-grams."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 8)
    monkeypatch.setattr(
        jaccard, "gram_counts", lambda texts, words: np.ones(jaccard.SLOTS, np.int64))
    draw = random.Random(9)
    shared = [f"s{i}" for i in range(300)]
    rows = []
    for base in range(60):
        text = shared + [f"b{base}w{i}" for i in range(300)]
        rows.append((len(rows), " ".join(text)))
        if base % 10 == 0:
            text[draw.randrange(300, 600)] = "x"
            rows.append((len(rows), " ".join(text)))
    met = []
    linked = jaccard._linked

    def counted(sets, part, whole):
        met.append(sets.count())
        return linked(sets, part, whole)

    monkeypatch.setattr(jaccard, "_linked", counted)
    want = expected(rows, 5, 80)
    assert len({component for *_, component in want}) == 60
    assert result(spark, rows, 5, 80) == want
    assert sum(met) == 12


@pytest.mark.parametrize("part", [80, 90, 100])
@pytest.mark.parametrize("seed", range(4))
def test_sketches_never_rule_out_similar_sets(part, seed):
    draw = np.random.default_rng(seed)
    sets = []
    for n in (1, 2, 5, 40, 300, 1100):
        base = draw.integers(0, 2**63, n).astype(np.uint64)
        for change in (0, 0, 0.05, 0.1, 0.2, 0.5):
            sets.append(np.unique(np.concatenate([
                base[draw.random(n) >= change],
                draw.integers(0, 2**63, int(draw.integers(0, max(2, n // 5)))).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    side = draw.random(len(sets)) < 0.5

    def joined(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return root

    for sides in (None, side):
        found = joined(sketches.near(
            np.array([len(s) for s in sets]), [sketches.sketch(s) for s in sets], part, 100, sides))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                shared = len(np.intersect1d(a, b))
                similar = 100 * shared >= part * (len(a) + len(b) - shared)
                if similar and (sides is None or sides[i] != sides[j]):
                    assert found[i] == found[j]
    assert len(set(joined(sketches.near(
        np.array([len(s) for s in sets]), [sketches.sketch(s) for s in sets], part, 100)))) > 5
