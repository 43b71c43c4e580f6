"""Phrases of words that occur together more often than their parts let expect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.arrow import rows_of
from quire.llm.common import numbered, text_of, width
from quire.llm.hat_trie import HatTrie
from quire.operators.skew import cut_lineage, lookup_join

LEAST = 30          # occurrences of a candidate
LONGEST = 4         # words of a candidate
SCALE = 2_000_000
ABSORBED = 80       # of a hundred occurrences inside a longer candidate
TOP = 2000
BLOCK = 4 << 20
WAITING = 8 << 20  # bytes of unfinished blocks in a task
SAMPLE_BLOCKS = 16
SALTS = 32
MOST_WORDS = 2**31 - 1

_GAPS = np.zeros(256, bool)
_GAPS[[0x20, 0x09]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCKS = "block long, lang string, words array<string>, times array<int>, places binary"
_WINDOWS = "hi long, lo long, n long"
_PHRASES = "hi long, lo long, m int, f long"


# -- blocks of texts as numbers of their words -------------------------------------------


class Block:
    """Texts of one language as the numbers of their distinct words; 0 is the end of a piece."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.parts: list[np.ndarray] = []

    def add(self, data: bytes) -> None:
        """Words of ``data``; a piece goes on in the next call if this one ends inside it."""
        raw = _LOWER[np.frombuffer(data, np.uint8)]
        stop = _STOPS[raw]
        inside = ~(stop | _GAPS[raw])
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        stops = np.flatnonzero(stop)
        # stops before each word, and behind the last one
        before = np.searchsorted(stops, np.append(starts, len(raw)))
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(starts),
            [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())])
        coded = pc.dictionary_encode(words)
        names = coded.dictionary.to_pylist()
        known = self.numbers
        number = np.fromiter(
            (known.setdefault(name, len(known) + 1) for name in names), np.int32, len(names))
        sequence = number[coded.indices.to_numpy()] if len(names) else number
        ended = np.flatnonzero(np.diff(before, prepend=0))
        self.parts.append(np.insert(sequence, ended, 0))

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        places = np.concatenate(self.parts)
        times = np.bincount(places, minlength=len(self.numbers) + 1)[1:]
        often = np.argsort(-times, kind="stable")
        rank = np.zeros(len(times) + 1, np.int32)
        rank[often + 1] = np.arange(1, len(times) + 1)
        # frequent words have small numbers, and a word takes two bytes where that is enough
        kind = "<u2" if len(times) < 1 << 16 else "<u4"
        packed = b"%d" % np.dtype(kind).itemsize + rank[places].astype(kind).tobytes()
        names = list(self.numbers)
        words = pa.array([names[i] for i in often.tolist()], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([lang]), _list(words),
             _list(pa.array(times[often].astype(np.int32))), pa.array([packed], pa.binary())],
            ["block", "lang", "words", "times", "places"])


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _cuts(data: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts that end between words; only a longer word makes a longer part."""
    at = 0
    while len(data) - at > limit:
        raw = np.frombuffer(data, np.uint8, limit, at)
        free = np.flatnonzero(_GAPS[raw] | _STOPS[raw])
        end = at + limit
        if len(free):
            end = at + int(free[-1]) + 1
        else:
            while end < len(data) and not (_GAPS[data[end]] or _STOPS[data[end]]):
                end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _block_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId(), 0
    texts: dict[str, list[bytes]] = {}
    waiting: dict[str, int] = {}
    held = 0

    def finished(lang: str) -> pa.RecordBatch:
        nonlocal made, held
        made, held = made + 1, held - waiting.pop(lang)
        block = Block()
        # a document ends the piece
        for part in _cuts(b"\n".join(texts.pop(lang)) + b"\n", BLOCK):
            block.add(part)
        return block.row((task << 32) + made, lang)

    for lang, text in rows_of(batches):
        data = text.encode()
        texts.setdefault(lang, []).append(data)
        waiting[lang] = waiting.get(lang, 0) + len(data)
        held += len(data)
        if waiting[lang] >= BLOCK:
            yield finished(lang)
        elif held >= WAITING:
            yield finished(max(waiting, key=waiting.get))
    for lang in list(texts):
        yield finished(lang)


# -- windows in prefix partitions ---------------------------------------------------------


def _word_numbers(places: bytes, at: list[int], ids: list[int]) -> np.ndarray:
    """A block's texts as the numbers all blocks share; 0 ends a piece, and so does a rare
    word, which is in no candidate."""
    local = np.frombuffer(places, f"<u{places[0] - 48}", offset=1)
    shared = np.zeros(int(local.max(initial=0)) + 1, np.int64)
    shared[np.array(at, np.int64)] = ids
    return shared[local]


def _windows(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of every place with two words or more: four numbers of 32 bits, 0 from the
    end of the piece on."""
    padded = np.concatenate([numbers, np.zeros(LONGEST - 1, np.int64)])
    n = len(numbers)
    words = [padded[k:n + k] for k in range(LONGEST)]
    for k in range(1, LONGEST):
        words[k] = np.where(words[k - 1] > 0, words[k], 0)
    some = words[1] > 0
    hi = (words[0][some] << 32) | words[1][some]
    return hi, (words[2][some] << 32) | words[3][some]


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.diff(hi, prepend=-1).astype(bool) | np.diff(lo, prepend=-1).astype(bool))
    return hi[first], lo[first], np.diff(np.append(first, len(hi)))


def _run_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to sorted runs of counted windows, through a trie of bounded size."""
    trie, runs, held = HatTrie(), [], 0

    def batch() -> pa.RecordBatch:
        windows = np.concatenate([run[0] for run in runs])
        counts = np.concatenate([run[1] for run in runs])
        halves = [pa.array(np.ascontiguousarray(windows[:, k]).astype(np.int64)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*halves, pa.array(counts)], ["hi", "lo", "n"])

    for places, at, ids in rows_of(batches):
        hi, lo, n = _distinct(*_windows(_word_numbers(places, at, ids)))
        packed = np.stack([hi, lo], axis=1).astype(">i8")
        del hi, lo
        for a in range(0, len(n), 25_000):
            some = packed[a:a + 25_000].tobytes()
            trie.add([some[i:i + 16] for i in range(0, len(some), 16)],
                     n[a:a + 25_000].tolist())
            for run in trie.spill():
                runs.append(run)
                held += len(run[1])
                if held >= 50_000:
                    yield batch()
                    runs, held = [], 0
    for run in trie.rest():
        runs.append(run)
        held += len(run[1])
        if held >= 50_000:
            yield batch()
            runs, held = [], 0
    if runs:
        yield batch()


def _pair_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for places, at, ids in rows_of(batches):
        hi, _ = _windows(_word_numbers(places, at, ids))
        pairs, n = np.unique(hi, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["hi", "n"])


def _merge_stage(least: int, hot: frozenset):
    """Sorted windows of a prefix partition to the phrases they begin with: two, three or four
    words, with their counts. One group per length is open at a time, so a partition of any
    size passes as a stream. Phrases of hot pairs may go on elsewhere: they are all kept."""

    masks = [0, ~0xFFFFFFFF, -1]  # the part of lo that belongs to two, three, four words
    hot_pairs = np.array(sorted(hot), np.int64)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        still_open = [None] * len(masks)

        def phrases(level: int, hi, lo, n) -> pa.RecordBatch | None:
            real = n >= least
            if len(hot_pairs):
                real |= np.isin(hi, hot_pairs)
            if level == 1:
                real &= lo != 0
            elif level == 2:
                real &= (lo & 0xFFFFFFFF) != 0
            if not real.any():
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(hi[real]), pa.array(lo[real]),
                 pa.array(np.full(int(real.sum()), level + 2, np.int32)), pa.array(n[real])],
                ["hi", "lo", "m", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, n = (batch.column(name).to_numpy() for name in ("hi", "lo", "n"))
            for level, mask in enumerate(masks):
                keys, rests, sums = hi, lo & mask, n
                if still_open[level] is not None:
                    a, b, c = still_open[level]
                    keys, rests = np.append(a, keys), np.append(b, rests)
                    sums = np.append(c, sums)
                new = (keys[1:] != keys[:-1]) | (rests[1:] != rests[:-1])
                first = np.concatenate([[0], np.flatnonzero(new) + 1])
                totals = np.add.reduceat(sums, first)
                keys, rests = keys[first], rests[first]
                still_open[level] = keys[-1:], rests[-1:], totals[-1:]
                done = phrases(level, keys[:-1], rests[:-1], totals[:-1])
                if done is not None:
                    yield done
        for level, group in enumerate(still_open):
            if group is not None:
                done = phrases(level, *group)
                if done is not None:
                    yield done

    return stage


def _with_numbers(blocks: DataFrame, occurrences: DataFrame, words: DataFrame, parts: int):
    """``places, at, ids``: blocks with the shared number of each of their frequent words."""
    found = occurrences.join(words.select("lang", "word", "id"), ["lang", "word"])
    of_block = found.repartition(parts, "block").groupBy("block").agg(
        F.collect_list("at").alias("at"), F.collect_list("id").alias("ids"))
    texts = blocks.select("block", "places").repartition(parts, "block")
    return texts.join(of_block, "block").select("places", "at", "ids")


def count_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of ``docs(text, lang)`` that occur ``least`` times or more: words with numbers
    ``(id, lang, word, n)``, phrases of two to four words ``(hi, lo, m, f)`` as numbers of 32
    bits each, and all words of a language ``(lang, n)``.

    A text becomes the numbers of its words; rare words end a piece, as no candidate holds
    them. Tasks count windows of four words in a trie and spill sorted runs of whole
    subtrees; a shuffle by the first two words brings the runs of a prefix together, sorts
    them, and one pass over them counts every prefix. The pairs that are most common in a
    sample of blocks are dealt by the whole window instead, and the counts of their phrases
    added up afterwards: the sample only balances the work.
    """
    spark = docs.sparkSession
    parts = width(spark)
    lang = F.coalesce("lang", F.lit("und")).alias("lang")
    blocks = cut_lineage(
        docs.select(lang, text_of().alias("text")).mapInArrow(_block_stage, _BLOCKS), "phrase-blocks")
    occurrences = blocks.select(
        "block", "lang", F.posexplode(F.arrays_zip("words", "times")).alias("pos", "entry")).select(
        "block", "lang", (F.col("pos") + 1).alias("at"),
        F.col("entry.words").alias("word"), F.col("entry.times").cast("long").alias("times"))
    totals = blocks.select(
        "lang", F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy(
        "lang").agg(F.sum("n").alias("n"))
    counted = occurrences.groupBy("lang", "word").agg(F.sum("times").alias("n"))
    frequent = counted.where(F.col("n") >= least).withColumn("_all", F.lit(0))
    placed = numbered(frequent, "_all", ["lang", "word"], "place", "phrase-words")
    number = F.when(F.col("place") < MOST_WORDS, F.col("place") + 1).otherwise(
        F.raise_error(F.lit("more frequent words than numbers of 31 bits")))
    words = cut_lineage(
        placed.select(number.cast("long").alias("id"), "lang", "word", "n"), "phrase-ids")

    sample = [row[0] for row in blocks.select("block").orderBy(
        F.xxhash64("block")).limit(SAMPLE_BLOCKS).collect()]
    chosen = F.col("block").isin(sample)
    pairs = _with_numbers(blocks.where(chosen), occurrences.where(chosen), words, parts).mapInArrow(
        _pair_stage, "hi long, n long").groupBy("hi").agg(F.sum("n").alias("n"))
    pairs = cut_lineage(pairs, "phrase-pairs")
    share = (pairs.agg(F.sum("n")).first()[0] or 0) / (4 * parts)
    hot = sorted(row["hi"] for row in pairs.where(F.col("n") > share).collect())  # < 4 x parts

    runs = _with_numbers(blocks, occurrences, words, parts).mapInArrow(_run_stage, _WINDOWS)
    salt = F.when(F.col("hi").isin(hot), F.col("lo")) if hot else F.lit(0)
    sorted_runs = runs.repartition(parts, "hi", salt).sortWithinPartitions("hi", "lo")
    merged = sorted_runs.mapInArrow(_merge_stage(least, frozenset(hot)), _PHRASES)
    if hot:
        is_hot = F.col("hi").isin(hot)
        merged = cut_lineage(merged, "phrase-merged")
        added = merged.where(is_hot).groupBy("hi", "lo", "m").agg(F.sum("f").alias("f"))
        merged = merged.where(~is_hot).unionByName(added.where(F.col("f") >= least))
    return words, cut_lineage(merged, "phrase-counts"), totals


# -- candidates ----------------------------------------------------------------------------


def _rest(k: int) -> tuple[Column, Column]:
    """A phrase without its first ``k`` words."""
    hi, lo = F.col("hi"), F.col("lo")
    if k == 1:
        return (F.shiftleft(hi, 32).bitwiseOR(F.shiftrightunsigned(lo, 32)), F.shiftleft(lo, 32))
    return (lo if k == 2 else F.shiftleft(lo, 32), F.lit(0).cast("long"))


def _first(k: int) -> tuple[Column, Column]:
    """The first ``k`` words of a phrase."""
    high = F.lit(~0xFFFFFFFF).cast("long")
    hi, lo = F.col("hi"), F.col("lo")
    if k == 1:
        return hi.bitwiseAND(high), F.lit(0).cast("long")
    return hi, (F.lit(0).cast("long") if k == 2 else lo.bitwiseAND(high))


def _named(pair: tuple[Column, Column], side: str) -> list[Column]:
    return [pair[0].alias(f"{side}_hi"), pair[1].alias(f"{side}_lo")]


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(SCALE * a / (l + r)); the product may pass 64 bits."""
    wide = "decimal(38,0)"
    product = a.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    parts = l.cast("decimal(19,0)") + r.cast("decimal(19,0)")
    return F.call_function("div", product.cast(wide), parts.cast(wide)).cast("long")


def scored_phrases(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """``hi, lo, m, f`` with ``l, r, score`` of the lowest cut, ties to the earliest."""
    every = phrases.select("hi", "lo", "f").unionByName(words.select(
        F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"),
        F.col("n").alias("f")))
    cuts = F.array(*[
        F.when(F.col("m") > k, F.struct(
            F.lit(k).alias("k"), *_named(_first(k), "l"), *_named(_rest(k), "r")))
        for k in range(1, LONGEST)])
    spread = phrases.select(
        "hi", "lo", "m", "f", F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("cut"),
    ).select("hi", "lo", "m", "f", "cut.*", F.xxhash64("hi", "lo").alias("_spread"))
    for side in ("l", "r"):
        key = [f"{side}_hi", f"{side}_lo"]
        counts = every.select(
            F.col("hi").alias(key[0]), F.col("lo").alias(key[1]), F.col("f").alias(side))
        spread = cut_lineage(
            lookup_join(spread, counts, key, "inner", "_spread").drop(*key), f"phrase-{side}")
    low = F.struct(score(F.col("f"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    best = spread.groupBy("hi", "lo", "m", "f").agg(F.min(low).alias("low"))
    return best.select("hi", "lo", "m", "f", "low.l", "low.r", "low.score")


def alone(candidates: DataFrame, phrases: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """Candidates that do not mostly occur inside a longer one. A longer candidate holds one
    with a single word more that is at least as common, so those are enough."""
    two = F.col("m") == 3
    start = F.struct("hi", F.when(two, F.lit(0).cast("long")).otherwise(_first(3)[1]).alias("lo"))
    end = F.struct(_rest(1)[0].alias("hi"), _rest(1)[1].alias("lo"))
    longer = phrases.where("m > 2").select("f", F.explode(F.array(start, end)).alias("inner"))
    most = longer.groupBy("inner.hi", "inner.lo").agg(F.max("f").alias("_most"))
    inside = F.lit(100).cast("decimal(10,0)") * F.col("_most").cast("decimal(19,0)") >= F.lit(
        absorbed).cast("decimal(10,0)") * F.col("f").cast("decimal(19,0)")
    return candidates.join(most, ["hi", "lo"], "left").where(
        ~F.coalesce(inside, F.lit(False))).drop("_most")


def _spelled(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with ``lang`` and ``phrase``, their words joined by spaces."""
    low = F.lit(0xFFFFFFFF).cast("long")
    ids = F.array(
        F.shiftrightunsigned("hi", 32), F.col("hi").bitwiseAND(low),
        F.shiftrightunsigned("lo", 32), F.col("lo").bitwiseAND(low))
    each = candidates.select("hi", "lo", F.posexplode(ids).alias("at", "id")).where("id <> 0")
    named = lookup_join(
        each.withColumn("_spread", F.xxhash64("hi", "lo")), words.select("id", "lang", "word"),
        ["id"], "inner", "_spread")
    spelled = named.groupBy("hi", "lo").agg(
        F.min("lang").alias("lang"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
        .alias("phrase"))
    return candidates.join(spelled, ["hi", "lo"])


def mine(
    docs: DataFrame, least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of every language.

    Letters A-Z are lowered, ``docs(text, lang)`` split at stops into pieces and those at
    blanks into words; a phrase is two to four words in a row within a piece that occur
    ``least`` times or more in the language. Cut in two, its count ``a`` is set against the
    counts ``l`` and ``r`` of its parts: floor(2000000 * a / (l + r)). The lowest cut counts,
    ties go to the earliest. Phrases of which ``absorbed`` of a hundred occurrences lie inside
    a longer candidate are left out. Each language's first ``top`` stay, by score, then a,
    then the phrase in the order of its bytes; ``n`` is the number of words of the language.

    Null texts are empty; a missing language is ``und``, together with one of that name.
    Repeated rows count. Very long texts are read in parts of some megabytes between words,
    so only a single longer word takes more memory. Other columns are ignored; without
    documents, or without candidates, the result is empty.
    """
    words, phrases, totals = count_phrases(docs, least)
    kept = cut_lineage(alone(scored_phrases(words, phrases), phrases, absorbed), "phrase-alone")
    named = _spelled(kept, words)
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    # a language may hold nearly all phrases: its best ones are found in many tasks first
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("hi", "lo"), F.lit(SALTS)))
    some = Window.partitionBy("lang", "_salt").orderBy(*order)
    few = salted.withColumn("_at", F.row_number().over(some)).where(F.col("_at") <= top)
    ranks = few.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranks.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
