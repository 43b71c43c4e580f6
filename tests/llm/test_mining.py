"""Phrases, exact search and resampling against plain Python, on awkward rows: nulls, empty
and long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import collocations, hat_trie, resampling, vectors


def collected(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# -- phrases -------------------------------------------------------------------------------


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_phrases(rows, least, absorbed, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i:i + size])] += 1
    out = []
    for lang, f in counts.items():
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in able.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inner[p[i:i + size]] = max(inner[p[i:i + size]], a)
        scored = []
        for p, a in able.items():
            if 100 * inner[p] >= absorbed * a and inner[p]:
                continue
            best = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                       for k in range(1, len(p)))
            scored.append((-best[0], -a, " ".join(p).encode(), a, best[2], best[3]))
        for rank, (low, _, phrase, a, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n[lang], -low))
    return sorted(out, key=repr)


def awkward_rows():
    draw = random.Random(5)
    words = ["the", "The", "of", "İzmir", "été", "a\x01b", "a", "\x00", "naïve", "x-y", "$", "b\x1c"]
    rows = [(None, None), ("und", "New York, New York"), ("en", ""), ("en", " \t.,;\n"),
            ("en", "the of " * 50), ("en", "the of " * 50)]
    for i in range(120):
        text = "".join(draw.choice(words) + draw.choice([" ", "  ", "\t", ", ", "\n", " ", " "])
                       for _ in range(draw.randint(1, 60)))
        rows.append((draw.choice(["en", "en", "en", "fr", None, "und", ""]), text))
    rows.append(("en", " ".join(draw.choice(words[:4]) for _ in range(20_000))))
    return rows


@pytest.mark.parametrize("most, block", [(300_000, 4 << 20), (40, 700)])
def test_phrases_are_those_of_plain_counting(spark, monkeypatch, most, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "WAITING", 2 * block)
    trie = collocations.HatTrie
    monkeypatch.setattr(collocations, "HatTrie", lambda: trie(burst=8, most=most))
    rows = awkward_rows()
    frame = spark.createDataFrame(
        [(lang, text, 1, "w", 7) for lang, text in rows],
        "lang string, text string, n long, words string, hi int").repartition(3)
    found = collocations.mine(frame, least=5, top=40)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collected(found, *found.columns) == plain_phrases(rows, 5, 80, 40)


def test_no_documents_and_no_candidates(spark):
    frame = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    assert collocations.mine(frame).count() == 0
    assert collocations.mine(frame.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 2**62 - 1, 2**62 + 7, 2**62 + 1
    frame = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    got = frame.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 2_000_000 * a // (l + r)


def test_a_common_pair_is_dealt_by_whole_windows(spark):
    rows = [("en", f"very common w{i % 40} w{i % 7}") for i in range(400)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    found = collocations.mine(frame, least=5)
    assert collected(found, *found.columns) == plain_phrases(rows, 5, 80, 2000)


def test_the_trie_counts_and_spills_sorted_subtrees():
    draw = random.Random(1)
    trie, counts, runs = hat_trie.HatTrie(burst=3, most=50), Counter(), []
    for _ in range(200):
        windows = [b"".join(draw.randint(1, 4).to_bytes(4) for _ in range(4)) for _ in range(10)]
        times = [draw.randint(1, 3) for _ in windows]
        for window, n in zip(windows, times):
            counts[window] += n
        trie.add(windows, times)
        runs.extend(trie.spill())
        assert trie.entries <= 50
    runs.extend(trie.rest())
    total = Counter()
    for found, n in runs:
        keys = [bytes(row.astype(">i8").tobytes()) for row in found]
        assert keys == sorted(set(keys)) and len({key[:4] for key in keys}) == 1
        for key, count in zip(keys, n.tolist()):
            total[key] += count
    assert total == counts and trie.entries == 0


# -- exact search --------------------------------------------------------------------------


def plain_nearest(rows, top, step):
    able = [(i, [math.floor(1024 * float(x)) for x in e]) for i, e in rows
            if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for at, (query, q) in enumerate(able):
        if query % step:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, c)), i)
                        for place, (i, c) in enumerate(able) if place != at)
        out += [(query, rank, i, -low) for rank, (low, i) in enumerate(scores[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind, large", [("float", 1.0), ("double", 1.0), ("double", 2.0**14)])
def test_nearest_are_those_of_all_products(spark, monkeypatch, kind, large):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "SHARE", 2)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "DIMENSIONS", 4)
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=10) * np.linspace(3, 0.1, 10) * large).astype("f4").tolist())
            for i in range(150)]
    common = rows[7][1]
    rows += [(200 + i, common) for i in range(40)]          # ties
    rows += [(10, rows[10][1]), (20, rows[20][1]), (0, common)]  # repeated ids and rows
    rows += [(300, None), (310, [1.0, None]), (320, [float("nan")]), (330, [float("inf")] * 10),
             (None, common), (340, []), (350, [0.5, -0.25]), (-30, common)]
    frame = spark.createDataFrame(
        [(i, e, 3, 4) for i, e in rows],
        f"vec_id long, embedding array<{kind}>, row int, rank int").repartition(3)
    found = vectors.nearest(frame, top=5, step=10)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert collected(found, *found.columns) == plain_nearest(rows, 5, 10)


def test_few_vectors_or_none(spark):
    frame = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert collected(vectors.nearest(frame), "query_id", "rank", "vec_id", "score") == [
        (0, 1, 1, 1024 * 512 + 2048 * 512)]
    assert vectors.nearest(frame.limit(0)).count() == 0
    assert vectors.nearest(frame.where("vec_id = 1")).count() == 0


def test_products_beyond_doubles_are_whole_numbers(spark):
    rows = [(0, [5e9, 1.0, 7.0]), (1, [2.0, 1.0, 3.0]), (2, [2.0, 1.0, 3.001]),
            (3, [1e300, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collected(vectors.nearest(frame), "rank", "vec_id", "score")
    whole = [[math.floor(1024 * x) for x in e] for _, e in rows]
    exact = [sum(a * b for a, b in zip(whole[0], e)) for e in whole]
    assert exact[2] > exact[1] > 2**53
    assert found == [(1, 3, 2**63 - 1), (2, 2, exact[2]), (3, 1, exact[1])]


def test_candidates_are_pruned_and_columns_compacted():
    draw = np.random.default_rng(0)
    lines = draw.integers(-1000, 1000, (64, 300)).astype(float)
    lines[16:] //= 100
    queries = vectors.Columns(np.arange(3), np.arange(3), lines[:, :3])
    block = vectors.Columns(np.arange(300), np.arange(300), lines)
    best = vectors.Best(queries, 4)
    vectors.visit(best, block)
    again = vectors.Best(queries, 4)
    again.least = best.least.copy()     # nothing but the best has to be finished
    vectors.visit(again, block)
    assert again.found == best.found
    products = lines[:, :3].T @ lines
    for q in range(3):
        order = sorted((-int(p), i, i) for i, p in enumerate(products[q]) if i != q)
        assert best.found[q] == order[:4]


# -- resampling ----------------------------------------------------------------------------


def grams(text, shortest, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), [" ".join(words[i:i + n]) for n in range(shortest, longest + 1)
                        for i in range(len(words) - n + 1)]


def plain_resample(rows, target, shortest, longest, buckets, least, percent):
    def counts(texts):
        return Counter(zlib.crc32(g.encode()) % buckets
                       for text in texts for g in grams(text, shortest, longest)[1])

    source, wanted = counts(t for _, t in rows), counts(target)
    all_s, all_t = sum(source.values()), sum(wanted.values())
    out = []
    for doc_id, text in rows:
        n, found = grams(text, shortest, longest)
        weight = sum(math.floor(1000 * math.log(
            (wanted[b] + 1) * (all_s + buckets) / ((source[b] + 1) * (all_t + buckets))))
            for b in (zlib.crc32(g.encode()) % buckets for g in found))
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, n, len(found), weight, score))
    able = sorted((row for row in out if row[1] >= least),
                  key=lambda row: (-row[4], row[0] is not None, row[0] or 0, row[2]))
    rank = defaultdict(list)
    for place, row in enumerate(able[:percent * len(able) // 100], 1):
        rank[row].append(place)
    return sorted(((*row, rank[row].pop() if rank[row] else None) for row in out), key=repr)


@pytest.mark.parametrize("shortest, longest", [(1, 1), (1, 3), (2, 2)])
def test_resampling_is_that_of_plain_counting(spark, monkeypatch, shortest, longest):
    monkeypatch.setattr(resampling, "SLICE", 300)
    draw = random.Random(shortest + longest)
    words = ["alpha", "Beta", "42", "été", "naïve", "x", "İ", "日本"]
    rows = [(1, None), (2, ""), (3, " .,;\x00"), (None, "alpha beta " * 8), (None, "alpha"),
            (4, " ".join(draw.choice(words) for _ in range(30_000)))]
    rows += [(i, "".join(draw.choice(words) + draw.choice(" -.\n_")
                         for _ in range(draw.randint(0, 40)))) for i in range(10, 80)]
    rows += [rows[-1], rows[-1], (11, rows[-1][1])]  # repeated rows, repeated ids
    target = ["alpha beta 42", None, "", "naïve x x x"]
    docs = spark.createDataFrame(
        [(i, t, "s", 1.5, 0) for i, t in rows],
        "doc_id long, text string, score string, rank double, bucket int").repartition(3)
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(docs, benchmark, shortest, longest, buckets=97, percent=30)
    got = collected(found, "doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert Counter(row[:5] for row in got) == Counter(
        row[:5] for row in plain_resample(rows, target, shortest, longest, 97, 20, 30))
    assert got == plain_resample(rows, target, shortest, longest, 97, 20, 30)


def test_resampling_keeps_texts_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    found = resampling.resample(docs, none, least_words=1, percent=100, keep=("doc_id", "text"))
    assert sorted((r["doc_id"], r["text"], r["rank"]) for r in found.collect()) == [
        (1, "a b c", 1), (2, None, None)]
    assert resampling.resample(docs.limit(0), none).count() == 0
