"""Removal of strings that occur again: windows by content-chosen anchors, compared by
interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import groups_of, rows_of
from quire.llm.bwt import repeated_windows
from quire.llm.common import text_of, width
from quire.llm.hashing import BASE, BASE_INVERSE, mixed, power
from quire.operators.skew import cut_lineage

LENGTH = 200
GRAM = 32
SLICE = 1 << 20
GROUP_BYTES = 1 << 20
ANCHOR_BYTES = 1 << 19
HOT_CONTEXTS = 1024
BROADCAST_BYTES = 32 << 20


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` neighbours."""
    step = 1
    while 2 * step <= n:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = n - step
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchored(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The windows of all texts, by the anchor of each: the 32 bytes inside it with the least
    hash, the leftmost of equal ones. Equal windows have equal anchors at equal places.

    Returns one entry per run of windows of a text with the same anchor: the text, the first
    window, the number of windows, where the first starts relative to the anchor, the hash
    of the anchor, and the hash of the run's bytes.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty, empty
    values = mixed(np.arange(1, 257, dtype=np.uint64))[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * power(BASE, len(data)), out=sums[1:])
    inverse = power(BASE_INVERSE, len(data))
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[:len(data) - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(packed, length - GRAM + 1) & low).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) + length <= ends[owner])
    if not len(starts):
        return empty, empty, empty, empty, empty, empty
    at = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    first = starts[heads]
    count = np.diff(np.append(heads, len(starts)))
    text = owner[first]
    context = mixed((sums[first + count - 1 + length] - sums[first]) * inverse[first]
                    + count.astype(np.uint64))
    return (text, first - (ends - sizes)[text], count, first - at[heads],
            grams[at[heads]].view(np.int64), context.view(np.int64))


def _slices(rows: Iterator[tuple], length: int) -> Iterator[tuple]:
    """(doc_id, content, offset, bytes): a long text in slices, each with the windows that
    start in it."""
    for doc_id, content, text in rows:
        data = (text or "").encode()
        for offset in range(0, max(len(data) - length + 1, 0), SLICE):
            yield doc_id, content, offset, data[offset:offset + SLICE + length - 1]


def _anchor_stage(length: int):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = _slices(rows_of(batches), length)
        for group in groups_of(slices, lambda row: len(row[3]), ANCHOR_BYTES):
            text, first, count, lead, gram, context = anchored([row[3] for row in group], length)
            ids, contents, offsets = (
                pa.array([row[i] for row in group], pa.int64()) for i in range(3))
            own = pa.array(text)
            place = first + offsets.to_numpy()[text]
            for at in range(0, len(text), 65_536):
                part = slice(at, at + 65_536)
                yield pa.RecordBatch.from_pydict({
                    "gram": gram[part], "context": context[part],
                    "doc_id": ids.take(own[part]), "content": contents.take(own[part]),
                    "place": place[part], "windows": count[part].astype(np.int32),
                    "lead": lead[part].astype(np.int32)})

    return stage


_RUN = "gram long, context long, doc_id long, content long, place long, windows int, lead int"


def _repeated_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by (gram, context): those whose anchor occurs again. The first run of
    each context is marked with how often the context occurs, 1 or 2 (for more)."""
    held: pa.RecordBatch | None = None
    behind = False  # whether the anchor of the first held row occurs before it
    begun = False  # and whether its context does
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        rows, behind, begun = _marked(batch, behind, begun, False)
        held = batch.slice(batch.num_rows - 1)
        if rows is not None:
            yield rows
    if held is not None:
        rows, _, _ = _marked(held, behind, begun, True)
        if rows is not None:
            yield rows


def _marked(batch: pa.RecordBatch, behind: bool, begun: bool, end: bool):
    """Marks all rows but the last, which waits for what follows, unless it is the end."""
    gram = batch.column(0).to_numpy(zero_copy_only=False)
    context = batch.column(1).to_numpy(zero_copy_only=False)
    same_gram = gram[1:] == gram[:-1]
    same = same_gram & (context[1:] == context[:-1])
    gram_before = np.concatenate([[behind], same_gram])
    before = np.concatenate([[begun], same])
    gram_after, after = np.append(same_gram, False), np.append(same, False)
    n = len(gram) if end else len(gram) - 1
    keep = np.flatnonzero((gram_before | gram_after)[:n])
    times = np.where(before, 0, np.where(after, 2, 1))[keep].astype(np.int32)
    rows = None
    if len(keep):
        some = batch.take(pa.array(keep))
        rows = pa.RecordBatch.from_arrays(
            [*some.columns, pa.array(times)], [*batch.schema.names, "times"])
    return rows, bool(gram_before[-1]), bool(before[-1])


def _fetch_stage(length: int):
    """Texts and the runs asked of them to the bytes of the runs."""
    schema = pa.schema([
        ("gram", pa.int64()), ("context", pa.int64()), ("times", pa.int32()),
        ("lead", pa.int32()), ("data", pa.binary()), ("skip", pa.int32())])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, asked in rows_of(batches):
            data = (text or "").encode()
            runs = np.frombuffer(asked, ">i8").reshape(-1, 6)
            for at in range(0, len(runs), 4096):
                part = runs[at:at + 4096]
                yield pa.RecordBatch.from_arrays([
                    part[:, 0].astype(np.int64), part[:, 1].astype(np.int64),
                    part[:, 2].astype(np.int32), part[:, 5].astype(np.int32),
                    pa.array([data[p:p + n + length - 1]
                              for p, n in part[:, 3:5].tolist()], pa.binary()),
                    np.zeros(len(part), np.int32)], schema=schema)

    return stage


def _split_stage(length: int, cell: int):
    """Runs of hot anchors cut at a grid of places relative to the anchor. All windows of a
    cell share the bytes from its last start to its first end, which become the new anchor."""
    schema = pa.schema([
        ("key", pa.int64()), ("gram", pa.int64()), ("context", pa.int64()),
        ("times", pa.int32()), ("lead", pa.int32()), ("data", pa.binary()),
        ("skip", pa.int32())])
    span = length - GRAM

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, gram, context, times, lead, data, skip in rows_of(iter([batch])):
                windows = len(data) - length + 1
                at = 0
                while at < windows:
                    grid = (lead + at + span) // cell
                    last = min(windows - 1, (grid + 1) * cell - span - 1 - lead)
                    core_from = (grid + 1) * cell - span - 1 - lead
                    core_to = grid * cell - span - lead + length
                    core = data[max(core_from, 0):core_to]
                    digest = hashlib.blake2b(core, digest_size=8, key=key.to_bytes(
                        8, "little", signed=True), salt=grid.to_bytes(8, "little")).digest()
                    rows.append({
                        "key": int.from_bytes(digest, "little", signed=True), "gram": gram,
                        "context": context, "times": times, "lead": lead + at,
                        "data": data[at:last + length], "skip": skip + at})
                    at = last + 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return stage


def _compare_stage(length: int):
    """From contexts sorted by key: the windows that occur again among those of their key,
    as places in the run (first and after last). Keys are put together up to a megabyte; one
    with a single row is passed over, as equal windows of a run do not exist: all windows of
    a run have one anchor, at different places in each."""
    schema = pa.schema([
        ("gram", pa.int64()), ("context", pa.int64()), ("hits", pa.list_(pa.int32()))])

    def found(group: list[tuple]) -> pa.RecordBatch:
        masks = repeated_windows(
            [row[4] for row in group], [row[3] for row in group], length)
        rows = []
        for (_, gram, context, _, _, skip), mask in zip(group, masks):
            if mask.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
                rows.append({"gram": gram, "context": context, "hits": (edges + skip).tolist()})
        return pa.RecordBatch.from_pylist(rows, schema)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size = 0
        for _, own in groupby(rows_of(batches), key=lambda row: row[0]):
            rows = list(own)
            if len(rows) == 1:
                continue
            if size >= GROUP_BYTES:
                yield found(group)
                group, size = [], 0
            group += rows
            size += sum(len(row[4]) + 1 for row in rows)
        if group:
            yield found(group)

    return stage


def _small(df: DataFrame, column: str) -> bool:
    """Whether the binary column and the keys beside it are few bytes altogether."""
    size = df.agg(F.sum(F.octet_length(column) + 32)).first()[0] or 0
    return size <= BROADCAST_BYTES


def _beside(texts: DataFrame, narrow: DataFrame, how: str, small: bool) -> DataFrame:
    """Texts joined to what belongs to them by doc_id and content."""
    named = narrow.withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    return texts.join(F.broadcast(named) if small else named, on, how)


def _merged(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Equal pieces of a key as one that counts 2, and the hits of all that are not alone:
    each of their windows occurs again. Equal windows stand alike to their anchor, so equal
    pieces have one lead."""
    own = F.struct("gram", "context", "lead", "skip")
    groups = cut_lineage(pieces.groupBy("key", "data").agg(
        F.sum("times").alias("n"), F.min(own).alias("own")), "distinct-pieces")
    again = groups.where("n > 1").select("key", "data")
    if _small(again, "data"):
        again = F.broadcast(again)
    windows = F.octet_length("data") - (length - 1)
    hits = pieces.join(again, ["key", "data"], "left_semi").select(
        "gram", "context", F.array("skip", F.col("skip") + windows).alias("hits"))
    kept = groups.select(
        "key", "own.gram", "own.context", F.least("n", F.lit(2)).cast("int").alias("times"),
        "own.lead", "data", "own.skip")
    return kept, hits


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition(width(rows.sparkSession), "key").sortWithinPartitions("key")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, content, spans``: for rows of ``docs(doc_id, content, text)`` in which a
    string of ``length`` bytes starts that also starts elsewhere, the byte ranges that such
    strings cover, merged and in order.

    1. Every window of ``length`` bytes has an anchor inside it that depends on its bytes
       alone, so equal windows meet by the anchor's hash, and only one run of windows in
       about seventy bytes is a row.
    2. Runs are sorted by anchor; those of anchors that occur once end here. Equal runs are
       one context with a number.
    3. The bytes of the contexts of an anchor are compared by interval expansion on their
       Burrows-Wheeler transform (``bwt.repeated_windows``), a megabyte of whole anchors at
       a time. An anchor with one context has nothing to compare: it repeats as a whole.
       Anchors with more than 1,024 contexts are split by longer strings around them, in at
       most four rounds, until each is small. After each round equal pieces become one, and
       what they hold is known to repeat, so only pieces that differ are cut again.
       A row of ``hits`` has first and after-last places in turn; null means all.
    4. What is found goes back to all runs of a context, and to the documents.
    """
    texts = docs.select("doc_id", "content", "text")
    parts = width(docs.sparkSession)
    runs = texts.mapInArrow(_anchor_stage(length), _RUN)
    ordered = runs.repartition(parts, "gram").sortWithinPartitions(
        "gram", "context", "doc_id", "content", "place")
    repeated = cut_lineage(
        ordered.mapInArrow(_repeated_stage, _RUN + ", times int"), "repeated-runs")

    contexts = repeated.where("times > 0")
    variety = contexts.groupBy("gram").agg(
        F.count(F.lit(1)).alias("contexts"), F.first("context").alias("one"))
    variety = cut_lineage(variety, "anchors")
    several = variety.where("contexts > 1").select("gram", "contexts")
    asked = contexts.join(several, "gram").groupBy("doc_id", "content").agg(
        F.array_join(F.collect_list(F.concat(*[
            F.lpad(F.hex(F.col(c).cast("long")), 16, "0")
            for c in ("gram", "context", "times", "place", "windows", "lead")])), "").alias("a"))
    asked = cut_lineage(
        asked.select("doc_id", "content", F.unhex("a").alias("asked")), "asked-runs")
    # rows that are there twice are fetched twice; their contexts count as repeated anyhow
    fetched = _beside(texts, asked, "inner", False)
    bytes_of = fetched.select("text", "asked").mapInArrow(
        _fetch_stage(length),
        "gram long, context long, times int, lead int, data binary, skip int")
    keyed = bytes_of.select(
        F.col("gram").alias("key"), "gram", "context", "times", "lead", "data", "skip")

    columns = ["key", "gram", "context", "times", "data", "skip"]
    hot = variety.where(F.col("contexts") > HOT_CONTEXTS).select("gram")
    results, found = [], []
    if not hot.isEmpty():
        keyed = cut_lineage(keyed, "context-bytes")
        busy = hot.select(F.col("gram").alias("busy"))
        for cell in (48, 12, 3, 1):
            is_busy = F.col("key") == F.col("busy")
            results.append(keyed.join(busy, is_busy, "left_anti").select(*columns))
            cut = cut_lineage(keyed.join(busy, is_busy, "left_semi").mapInArrow(
                _split_stage(length, cell),
                "key long, gram long, context long, times int, lead int, data binary, skip int"),
                "context-pieces")
            keyed, again = _merged(cut, length)
            found.append(again)
            busy = cut_lineage(keyed.groupBy("key").count().where(
                F.col("count") > HOT_CONTEXTS).select(F.col("key").alias("busy")), "hot-keys")
            if busy.isEmpty():
                break
    # cells of one start are equal where their keys are, so in the end no key is busy
    compared = keyed.select(*columns)
    for more in results:
        compared = compared.unionByName(more)
    hits = _by_key(compared).mapInArrow(
        _compare_stage(length), "gram long, context long, hits array<int>")
    for more in found:
        hits = hits.unionByName(more)
    hits = cut_lineage(hits, "repeated-windows")

    merged = hits.groupBy("gram", "context").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    alone = variety.where("contexts = 1").select(
        "gram", F.col("one").alias("context"), F.lit(None).cast("array<int>").alias("hits"))
    places = repeated.select("gram", "context", "doc_id", "content", "place", "windows")
    joined = places.join(merged.unionByName(alone), ["gram", "context"])
    place = F.col("place")
    inside = F.transform(
        "hits", lambda x, i: x.cast("long") + place + F.when(i % 2 == 1, length - 1).otherwise(0))
    all_of = F.array(place, place + F.col("windows") - 1 + length)
    edges = F.when(F.col("hits").isNull(), all_of).otherwise(inside)
    gathered = joined.groupBy("doc_id", "content").agg(
        F.flatten(F.collect_list(edges)).alias("edges"))
    return gathered.mapInArrow(_merge_stage, "doc_id long, content long, spans binary")


def _merge_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a document, in any order and overlapping, to runs in order."""
    for batch in batches:
        spans = []
        for edges in batch.column("edges"):
            pairs = np.array(edges.as_py(), np.int64).reshape(-1, 2)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            reach = np.maximum.accumulate(pairs[:, 1])
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:, 0] > reach[:-1]
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(pairs)) - 1
            spans.append(np.stack([pairs[heads, 0], reach[tails]], 1).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("content"), pa.array(spans, pa.binary())],
            ["doc_id", "content", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("content"), text.alias("text"))


def _cut(data: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """What is left of the bytes, and how many runs are gone."""
    if not spans:
        return data, 0
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()
    kept, at = [], 0
    for start, end in pairs:
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    return b"".join(kept), len(pairs)


def _digest_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        rows = []
        for doc_id, text, spans in rows_of(iter([batch])):
            data = text.encode()
            left, n = _cut(data, spans)
            rows.append({
                "doc_id": doc_id, "n_bytes": len(data), "n_removed": len(data) - len(left),
                "n_spans": n, "kept_sha256": hashlib.sha256(left).hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, schema)


def remove_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of
    ``docs(doc_id, text)``.

    Each byte that a string of ``length`` bytes covers which also starts elsewhere, in the
    same text or another, is removed; strings are judged on the input. Null texts are empty;
    texts shorter than ``length`` stay whole; repeated rows repeat each other; other columns
    are ignored; a table without rows gives none.
    """
    texts = _keyed(docs)
    spans = cut_lineage(repeated_spans(texts, length), "repeated-spans")
    joined = _beside(texts, spans, "left", _small(spans, "spans"))
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _digest_stage,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_characters(data: bytes, spans: bytes) -> bytes:
    """The text without the spans, each drawn in to whole characters."""
    kept, at = [], 0
    for start, end in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist():
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    return b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated strings, characters kept whole; n_chars follows. Rows in
    which nothing repeats stay as they are, and so do all other columns."""
    spans = cut_lineage(repeated_spans(_keyed(docs), length), "repeated-spans")
    whole = docs.select(F.struct("*").alias("_row"))
    keyed = whole.select(
        "_row", F.col("_row.doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("_row.text", F.lit(""))).alias("content"))
    joined = _beside(keyed, spans, "left", _small(spans, "spans"))

    @F.pandas_udf("string")
    def shortened(texts, cuts):
        import pandas as pd
        return pd.Series([
            text if not spans else _whole_characters(text.encode(), bytes(spans)).decode()
            for text, spans in zip(texts, cuts)], dtype=object)

    done = joined.select("_row", "spans", shortened(F.col("_row.text"), F.col("spans")).alias("_t"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("_t").alias("text"))
        elif name == "n_chars":
            columns.append(F.when(
                F.col("spans").isNotNull(), F.length("_t").cast(docs.schema[name].dataType)
            ).otherwise(F.col("_row.n_chars")).alias(name))
        else:
            columns.append(F.col(f"_row.`{name}`").alias(name))
    return done.select(*columns)
