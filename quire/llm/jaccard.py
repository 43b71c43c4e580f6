"""Groups of documents whose sets of word n-grams are similar, by a prefix-tree join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.arrow import groups_of, rows_of
from quire.llm.common import components, matched, text_of, width
from quire.llm.hashing import mixed, shingle_hashes, word_hashes
from quire.llm.sketches import near_stage, sketch
from quire.llm.trie import link_counts, links
from quire.operators.skew import cut_lineage
from quire.session import drop_finished_shuffles, remove, shared_folder

SLOTS = 1 << 20
PIECE = 1 << 12
SALTS = 32
BATCH_BYTES = 1 << 19
CHUNK_SETS = 512
CHUNK_GRAMS = 1 << 20
SKETCH_SETS = 2048
SKETCH_BYTES = 4 << 20


def gram_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The distinct n-grams of each text as sorted hashes."""
    hashes, counts = word_hashes([text.encode() for text in texts])
    grams, number = shingle_hashes(hashes, counts, words)
    return [np.unique(part) for part in np.split(grams, np.cumsum(number)[:-1])]


def _count_stage(words: int):
    """How many documents have an n-gram of each slot, per task and piece of the slots."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, np.int64)
        for group in groups_of(rows_of(batches), lambda row: len(row[0]), BATCH_BYTES):
            grams = np.concatenate(gram_sets([text for text, in group], words))
            slots += np.bincount((grams >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        for piece in range(SLOTS // PIECE):
            part = slots[piece * PIECE:(piece + 1) * PIECE]
            if part.any():
                yield pa.RecordBatch.from_pydict({
                    "piece": pa.array([piece], pa.int32()),
                    "counts": pa.array([_packed(part)], pa.binary())})

    return stage


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * PIECE, "zstd", asbytes=True), "<i8")


def _sum_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for piece, counts in rows_of(batches):
        sums[piece] = sums.get(piece, 0) + _unpacked(counts)
    for piece, counts in sums.items():
        yield pa.RecordBatch.from_pydict({
            "piece": pa.array([piece], pa.int32()),
            "counts": pa.array([_packed(counts)], pa.binary())})


def gram_counts(texts: DataFrame, words: int) -> np.ndarray:
    """Upper bounds of the numbers of documents that have an n-gram, by slots of a hash.

    All documents are counted into a table of a fixed size (8 MB), which sums up in two
    steps, so its parts are streams of a bounded number of small rows.
    """
    kind = "piece int, counts binary"
    counted = texts.select("text").mapInArrow(_count_stage(words), kind)
    salted = counted.withColumn(
        "salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("piece", "salt")
    sums = salted.drop("salt").mapInArrow(_sum_stage, kind)
    total = sums.repartition("piece").mapInArrow(_sum_stage, kind)
    slots = np.zeros(SLOTS, np.int64)
    for piece, counts in total.collect():  # SLOTS / PIECE rows
        slots[piece * PIECE:(piece + 1) * PIECE] = _unpacked(bytes(counts))
    return slots


def _set_stage(words: int, part: int, whole: int, slots):
    """Per document: size and digest of its set, and the rarest n-grams that any similar set
    must share one of."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("content", pa.int64()), ("n", pa.int64()),
        ("node", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = slots.value
        for group in groups_of(rows_of(batches), lambda row: len(row[2]), BATCH_BYTES):
            rows = []
            sets = gram_sets([text for _, _, text in group], words)
            for (doc_id, content, _), grams in zip(group, sets):
                n = len(grams)
                digest = np.array(
                    [grams.sum(), mixed(grams ^ np.uint64(n)).sum()], "<u8").tobytes()
                order = np.argsort(counts[(grams >> np.uint64(44)).astype(np.int64)],
                                   kind="stable")
                length = n - -(-part * n // whole) + 1 if n else 0
                rows.append({
                    "doc_id": doc_id, "content": content, "n": n, "node": digest,
                    "prefix": grams[order[:length]].view(np.int64)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return stage


def _meet_stage(part: int, whole: int):
    """From rows sorted by (gram, n, early, brief): edges that hold all candidates together.

    Of two similar sets, the smaller one has the n-gram early. So an early row points at the
    first early one of its run, which ends with the n-gram or where sizes of early rows are
    too far apart for any pair across; a late row points there too if the last early row,
    which is smaller, is large enough, and else at nothing.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple[int, int, int] | None = None  # n-gram and size of a run's end, its head
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, sizes, early, nodes = (
                column.to_numpy(zero_copy_only=False) for column in batch.columns)
            if carried:
                grams, sizes, nodes = (
                    np.concatenate([[value], column])
                    for value, column in zip(carried, (grams, sizes, nodes)))
                early = np.concatenate([[True], early])
            at = np.flatnonzero(early)
            if not len(at):
                continue
            gram, size = grams[at], sizes[at].astype(np.int64)
            starts = np.ones(len(at), bool)
            starts[1:] = (gram[1:] != gram[:-1]) | (whole * size[:-1] < part * size[1:])
            head = nodes[at[np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))]]
            late = np.flatnonzero(~early)
            before = np.searchsorted(at, late) - 1
            late, before = late[before >= 0], before[before >= 0]
            meets = (gram[before] == grams[late]) & (
                whole * size[before] >= part * sizes[late].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([nodes[at[~starts]], nodes[late[meets]]])),
                 pa.array(np.concatenate([head[~starts], head[before[meets]]]))], schema=schema)
            carried = int(gram[-1]), int(size[-1]), int(head[-1])

    return stage


def segment_signatures(grams: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Signatures of which any two similar sets share one.

    Sets of similar sizes differ in at most d n-grams. Cut the hash space into k > d
    segments, and at least k - d segments are equal in both; the signature of a segment is
    a hash of all n-grams in it. Sizes are dealt to classes, and a set also signs for the
    next class where it is large enough for a set of that. Segments with few n-grams say
    little, so a set leaves its smallest ones out, as long as those of up to w n-grams are
    fewer than k - d. Of two similar sets, the one with the larger w has then an equal
    segment above w, which the other one signs as well.
    """
    n, found, lowest, kind = len(grams), [], 1, 0
    while True:
        highest = max(lowest, lowest * 5 // 4)
        if whole * n < part * lowest:
            return np.concatenate(found) if found else np.zeros(0, np.uint64)
        if n <= highest:
            d = (whole - part) * 2 * highest // (whole + part)
            k = d + 1 + d // 4
            segment = ((mixed(grams) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            segment = segment.astype(np.int64)
            sums = np.zeros(k, np.uint64)
            np.add.at(sums, segment, mixed(grams ^ np.uint64(0x5851F42D4C957F2D)))
            held = np.bincount(segment, minlength=k)
            smaller = np.cumsum(np.bincount(held))  # how many segments hold up to that many
            signed = np.flatnonzero(held >= int(np.searchsorted(smaller, k - d)))
            place = mixed(signed.astype(np.uint64) + np.uint64(kind << 32))
            found.append(mixed(sums[signed] ^ place))
        lowest, kind = highest + 1, kind + 1


def _signature_stage(words: int, part: int, whole: int):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(rows_of(batches), lambda row: len(row[1]), BATCH_BYTES):
            sets = gram_sets([text for _, text in group], words)
            for (brief, _), grams in zip(group, sets):
                signs = segment_signatures(grams, part, whole)
                yield pa.RecordBatch.from_pydict({
                    "gram": signs.view(np.int64),
                    "n": np.full(len(signs), len(grams), np.int32),
                    "early": np.ones(len(signs), bool),
                    "brief": np.full(len(signs), brief, np.int64)})

    return stage


def _sketch_stage(words: int):
    """Rows (component, brief, text) to those with the size and the sketch of the set."""
    schema = pa.schema([("component", pa.int64()), ("brief", pa.int64()), ("n", pa.int64()),
                        ("sketch", pa.binary())])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(rows_of(batches), lambda row: len(row[2]), BATCH_BYTES):
            sets = gram_sets([text for _, _, text in group], words)
            yield pa.RecordBatch.from_arrays([
                pa.array([row[0] for row in group], pa.int64()),
                pa.array([row[1] for row in group], pa.int64()),
                pa.array([len(grams) for grams in sets], pa.int64()),
                pa.array([sketch(grams).tobytes() for grams in sets], pa.binary())],
                schema=schema)

    return stage


def _meeting_sketches(sketches: DataFrame, part: int, whole: int) -> DataFrame:
    """Rows (key, cross, side, brief, n, sketch) of ``sketches(component, brief, n, sketch)``
    such that any two sets of a component whose sizes allow them to be similar share a key.

    Sizes are dealt to classes, so that similar sets are of one class or of neighbours, and
    the sets of a class to chunks of bounded bytes. Every chunk meets the chunks of its own
    class and those of the next one.
    """
    step = float(np.log(whole / part * 1.001))  # a little more than similar sizes differ by
    classed = sketches.withColumn("class", F.floor(F.log("n") / step).cast("int"))
    by_class = Window.partitionBy("component").orderBy("class")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / SKETCH_SETS),
                      F.ceil(F.sum(F.octet_length("sketch")) / SKETCH_BYTES)).cast("int")

    def chunks_at(offset: int) -> Column:
        near = F.lead("class", offset).over(by_class) == F.col("class") + offset
        return F.coalesce(F.when(near, F.lead("chunks", offset).over(by_class)), F.lit(0))

    chunks = cut_lineage(
        classed.groupBy("component", "class").agg(size.alias("chunks")).withColumns(
            {"after": chunks_at(1), "before": chunks_at(-1)}), "sketch-chunks")
    own = F.pmod(F.xxhash64("brief"), F.col("chunks")).cast("int")

    def numbers(count: str) -> Column:
        every = F.sequence(F.lit(0), F.col(count) - 1)
        return F.when(F.col(count) > 0, every).otherwise(F.array().cast("array<int>"))

    def meeting(low: Column, first: Column, second: Column, next_class: bool,
                cross: Column, side: Column) -> Column:
        key = F.xxhash64("component", low, first, second, F.lit(next_class))
        return F.struct(key.alias("key"), cross.alias("cross"), side.alias("side"))

    kind, yes, no = F.col("class"), F.lit(True), F.lit(False)
    same = F.transform(numbers("chunks"), lambda i: meeting(
        kind, F.least(own, i), F.greatest(own, i), False, own != i, own > i))
    after = F.transform(numbers("after"), lambda i: meeting(kind, own, i, True, yes, no))
    before = F.transform(numbers("before"), lambda i: meeting(kind - 1, i, own, True, yes, yes))
    return classed.join(chunks, ["component", "class"]).withColumn(
        "met", F.explode(F.concat(same, after, before))).select(
            "met.key", "met.cross", "met.side", "brief", "n", "sketch")


LINK_COLUMNS = {
    "key": pa.int64(), "probe": pa.bool_(), "cluster": pa.binary(), "node": pa.binary()}
COUNT_COLUMNS = {"component": pa.int64(), "chunks": pa.int32(), "node": pa.binary()}


def _gram_stage(words: int, kinds: dict[str, pa.DataType]):
    """Rows of these columns and a text become rows of them and the n-grams."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(rows_of(batches), lambda row: len(row[-1]), BATCH_BYTES):
            sets = gram_sets([row[-1] for row in group], words)
            columns = [pa.array([row[i] for row in group], kind)
                       for i, kind in enumerate(kinds.values())]
            grams = pa.array([grams.tobytes() for grams in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, grams], [*kinds, "grams"])

    return stage


def _link_stage(part: int, whole: int):
    """Edges among the sets of each group; groups come one after the other. A row is
    (key, probe, cluster, node, grams); with probes in a group, only their pairs count."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def found(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        nodes = [row[3] for row in group]
        sets = [np.frombuffer(row[4], np.uint64) for row in group]
        clusters = {cluster: i for i, cluster in enumerate({row[2] for row in group})}
        labels = np.array([clusters[row[2]] for row in group])
        probes = [i for i, row in enumerate(group) if row[1]]
        pairs = links(sets, part, whole, labels, probes or None)
        if pairs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[a] for a, _ in pairs], pa.binary()),
                 pa.array([nodes[b] for _, b in pairs], pa.binary())], schema=schema)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for row in rows_of(batches):
            if group and row[0] != group[0][0]:
                yield from found(group)
                group = []
            group.append(row)
        if group:
            yield from found(group)

    return stage


def _number_stage(part: int, whole: int):
    """Numbers of similar sets within each group; groups come one after the other. A row is
    (key, cross, probe, node, grams); in a group that is cross, only pairs of a probe with
    another set count. Rows of one node are one set."""
    schema = pa.schema([("node", pa.binary()), ("n", pa.int64())])

    def found(cross: bool, group: dict[bytes, tuple]) -> pa.RecordBatch:
        sets = [np.frombuffer(row[4], np.uint64) for row in group.values()]
        probes = [i for i, row in enumerate(group.values()) if row[2]] if cross else None
        counts = link_counts(sets, part, whole, probes)
        return pa.RecordBatch.from_arrays(
            [pa.array(group, pa.binary()), pa.array(counts, pa.int64())], schema=schema)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cross, group = None, False, {}
        for row in rows_of(batches):
            if group and row[0] != key:
                yield found(cross, group)
                group = {}
            key, cross = row[:2]
            group[row[3]] = row
        if group:
            yield found(cross, group)

    return stage


def _linked(rows: DataFrame, part: int, whole: int) -> DataFrame:
    """Edges of ``rows(key, probe, cluster, node, grams)``, grouped by key."""
    parts = width(rows.sparkSession)
    dealt = rows.select("key", "probe", "cluster", "node", "grams").repartition(
        parts, "key").sortWithinPartitions("key", "probe", "node")
    return dealt.mapInArrow(_link_stage(part, whole), "a binary, b binary")


def similar_sets(
    docs: DataFrame, words: int, part: int, whole: int, count: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``(rows, groups, counts)``: ``rows(doc_id, content, n, node)`` has every row of
    ``docs(doc_id, text)`` with the digest of its n-gram set, and ``groups(node, group)``
    the sets that links connect with others. With ``count``, ``counts(node, n_links)`` has
    the number of different sets that each set with a candidate is similar to, else it is None.

    1. N-grams are counted over all documents, in slots. That gives one order of all
       n-grams, rare before frequent, so that common passages come last.
    2. Equal sets become one node. Sets that can be similar share one of the first n-grams
       of their order (as many as the threshold lets two sets differ, and one). Nodes that
       share one, and have sizes and places of it that allow it, are joined by edges along
       each run of the sorted n-grams: a star, never all pairs. Its components hold all
       candidates. For a similar set of its own size or larger, a set needs only about half
       of those n-grams (``early``), so copies with changes of their own, whose first n-grams
       nobody shares, do not meet at those that all copies have.
    3. Components of more than 512 sets, or of a million n-grams, are mostly held together
       by passages that many different texts share. Their sets are cut into segments such
       that similar sets have an equal one (``segment_signatures``), and only sets with an
       equal segment stay together. Components that are still large, such as those of long
       texts, which have many segments, are cut by bitmaps of their sets (``sketches``), a
       sixteenth to a 32nd of the n-grams' bytes: all pairs of sizes that can be similar are
       compared, and only sets whose bitmaps do not rule it out stay together.
    4. The sets of a component meet in one task, in a trie (``trie.links``). A component of
       more than 512 sets, or of a million n-grams, is cut into chunks, each with the
       component's first set: copies of one text are thereby connected in one pass over
       the chunks. What is then not connected with the first set is compared with every
       chunk, so no pair that could connect more sets is left out. This finds what is
       connected, not every link.
    5. With ``count``, every chunk of a component meets every chunk, itself included, and
       all pairs are looked at (``trie.link_counts``). That costs the square of a
       component's chunks; only numbers leave the tasks.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    slots = docs.sparkSession.sparkContext.broadcast(gram_counts(texts, words))  # 8 MB
    spark = docs.sparkSession
    wide = texts.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(
        _set_stage(words, part, whole, slots),
        "doc_id long, content long, n long, node binary, prefix array<long>")
    folder = shared_folder(spark, "gram-sets")
    wide.write.parquet(folder)
    wide = spark.read.schema(wide.schema).parquet(folder)
    rows = cut_lineage(wide.drop("prefix"), "set-rows")
    some = rows.where("n > 0")
    # brief stands for a node where nothing is lost if two nodes share it
    nodes = wide.where("n > 0").groupBy("node").agg(
        F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix"))
    # a set shares one of its first n - least + 1 n-grams with any similar set of its size or
    # larger, least being the overlap that sets of its size need
    least = F.ceil(2 * part * F.col("n") / (part + whole))
    entries = nodes.select(
        "n", F.xxhash64("node").alias("brief"), F.posexplode("prefix").alias("place", "gram")
    ).select("gram", "n", (F.col("place") <= F.col("n") - least).alias("early"), "brief")

    def together(rows: DataFrame) -> DataFrame:
        """Components of the nodes that share a gram of ``rows(gram, n, early, brief)``."""
        ordered = rows.repartition(width(spark), "gram").sortWithinPartitions(
            "gram", "n", "early", "brief")
        met = ordered.mapInArrow(_meet_stage(part, whole), "a long, b long")
        return components(met, "candidates").select(F.col("id").alias("_brief"), "component")

    candidates = together(entries)
    remove(spark, folder)  # its n-grams are half of the input
    drop_finished_shuffles(spark)

    chosen = some.groupBy("node").agg(
        F.min(F.struct("doc_id", "content")).alias("row"), F.first("n").alias("n"))
    briefed = chosen.withColumn("brief", F.xxhash64("node")).join(
        candidates, F.col("brief") == F.col("_brief"))
    wanted = cut_lineage(briefed.select(
        F.col("row.doc_id").alias("_id"), F.col("row.content").alias("_content"), "node",
        "component", "n"), "wanted-sets")

    def text_of_sets(rows: DataFrame) -> DataFrame:
        return matched(
            texts, rows, F.col("doc_id").eqNullSafe(F.col("_id"))
            & (F.xxhash64("text") == F.col("_content")), "inner", rows.count())

    pieces = F.greatest(
        F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_GRAMS)).cast("int")

    def sized_sets(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("component").agg(
            pieces.alias("chunks"), F.min("node").alias("first"))
        return cut_lineage(rows.join(sizes, "component"), "sized-sets")

    sized = sized_sets(wanted)
    def by_segments(loose: DataFrame) -> DataFrame:
        signs = text_of_sets(loose).select("brief", "text").mapInArrow(
            _signature_stage(words, part, whole), "gram long, n int, early boolean, brief long")
        return together(signs)

    def by_sketches(loose: DataFrame) -> DataFrame:
        sketches = cut_lineage(
            text_of_sets(loose).select("component", "brief", "text").mapInArrow(
                _sketch_stage(words), "component long, brief long, n long, sketch binary"),
            "sketches")
        dealt = _meeting_sketches(sketches, part, whole).repartition(
            width(spark), "key").sortWithinPartitions("key")
        met = dealt.mapInArrow(near_stage(part, whole), "a long, b long")
        return components(met, "sketched").select(F.col("id").alias("_brief"), "component")

    for closer in (by_segments, by_sketches):
        loose = sized.where("chunks > 1").select(*wanted.columns)
        if loose.isEmpty():
            break
        loose = loose.withColumn("brief", F.xxhash64("node"))
        closest = loose.drop("component").join(closer(loose), F.col("brief") == F.col("_brief"))
        kept = sized.where("chunks = 1").select(*wanted.columns)
        sized = sized_sets(cut_lineage(
            kept.unionByName(closest.select(*wanted.columns)), "closer-sets"))
        drop_finished_shuffles(spark)

    def sets_of(rows: DataFrame) -> DataFrame:
        """The rows with the n-grams of their texts. Texts are hashed anew, not kept."""
        return text_of_sets(rows).select("key", "probe", "cluster", "node", "text").mapInArrow(
            _gram_stage(words, LINK_COLUMNS),
            "key long, probe boolean, cluster binary, node binary, grams binary")

    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)
    dealt = sized.withColumn("chunk", F.explode(
        F.when(F.col("node") == F.col("first"), everywhere).otherwise(F.array(own))))
    inside = cut_lineage(_linked(sets_of(dealt.select(
        "_id", "_content", F.xxhash64("component", "chunk").alias("key"),
        F.lit(False).alias("probe"), F.col("node").alias("cluster"), "node")), part, whole),
        "links")

    large = sized.where("chunks > 1")
    if not large.isEmpty():
        joined = components(inside, "clusters").select(F.col("id").alias("_n"), "component")
        named = joined.withColumnRenamed("component", "cluster")
        labelled = cut_lineage(large.join(named, F.col("node") == F.col("_n"), "left").select(
            "_id", "_content", "component", "chunks", "node", "first",
            F.coalesce("cluster", "node").alias("cluster")), "labelled-sets")
        firsts = labelled.where("node = first").select(
            F.col("component").alias("_component"), F.col("cluster").alias("_cluster"))
        marked = labelled.join(firsts, F.col("component") == F.col("_component"))
        apart = cut_lineage(marked.where("cluster <> _cluster").select(
            *labelled.columns), "sets-apart")
        blocks = apart.groupBy("component").agg(
            F.ceil(F.count(F.lit(1)) / CHUNK_SETS).cast("int").alias("blocks"))
        columns = ["_id", "_content", F.xxhash64("component", "chunk", "block").alias("key"),
                   "probe", "cluster", "node"]
        index = labelled.join(blocks, "component").withColumns({
            "chunk": own, "probe": F.lit(False),
            "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).select(*columns)
        probes = apart.join(blocks, "component").withColumns({
            "chunk": F.explode(everywhere), "probe": F.lit(True),
            "block": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")}).select(*columns)
        crossed = cut_lineage(index.unionByName(probes), "crossed-sets")
        inside = inside.unionAll(_linked(sets_of(crossed), part, whole))
    groups = components(inside, "similar").select(
        F.col("id").alias("node"), F.col("component").alias("group"))
    counts = None
    if count:
        grams = text_of_sets(sized).select(*COUNT_COLUMNS, "text").mapInArrow(
            _gram_stage(words, COUNT_COLUMNS),
            "component long, chunks int, node binary, grams binary")
        own, other = F.col("own"), F.col("other")
        met = grams.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        met = met.withColumn("other", F.explode(everywhere)).select(
            F.xxhash64("component", F.least(own, other), F.greatest(own, other)).alias("key"),
            (own != other).alias("cross"), (own < other).alias("probe"), "node", "grams")
        dealt = met.repartition(width(spark), "key").sortWithinPartitions("key")
        numbers = dealt.mapInArrow(_number_stage(part, whole), "node binary, n long")
        counts = cut_lineage(numbers.groupBy("node").agg(F.sum("n").alias("n_links")), "link-counts")
    return rows.select("doc_id", "content", "n", "node"), groups, counts


def _with_groups(
    rows: DataFrame, groups: DataFrame, least: Column, counts: DataFrame | None = None
) -> DataFrame:
    """``rows`` with the least row of each one's group; with ``counts``, also with the least
    row of the same set (``first``) and the number of its links."""
    firsts = rows.groupBy("node").agg(F.min(least).alias("first"))
    named = groups.select(F.col("node").alias("_node"), "group")
    grouped = firsts.join(named, F.col("node") == F.col("_node"), "left").select(
        "node", "first", F.coalesce("group", "node").alias("group"))
    of_group = grouped.groupBy("group").agg(F.min("first").alias("least"))
    of_node = cut_lineage(
        grouped.join(of_group, "group").select(
            F.col("node").alias("_node"), "least", *(["first"] if counts is not None else [])),
        "group-names")
    if counts is not None:
        named = counts.select(F.col("node").alias("_counted"), "n_links")
        of_node = of_node.join(named, F.col("_node") == F.col("_counted"), "left").select(
            "_node", "least", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(of_node, F.col("node") == F.col("_node")).drop("_node")


def near_duplicates(
    docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Two documents link where whole * intersection >= part * union of their distinct n-grams
    of words (A-Z in lower case); component_id is the smallest doc_id that links reach. A
    text with fewer words than an n-gram has one, all of it; null and empty texts have none
    and link with nothing. Repeated rows are equal sets. Other columns are ignored; a table
    without rows gives none.
    """
    rows, groups, _ = similar_sets(docs, words, part, whole)
    linked = _with_groups(rows.where("n > 0"), groups, F.struct("doc_id", "content"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"),
                                       F.col("doc_id").alias("component_id"))
    return linked.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.col("least.doc_id").alias("component_id")).unionByName(alone)


def near_links(
    docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100
) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id, n_links`` for every row, as in
    ``near_duplicates``: class_id is the smallest doc_id with the same set of n-grams, and
    n_links the number of all other different sets that link with this one."""
    rows, groups, counts = similar_sets(docs, words, part, whole, count=True)
    linked = _with_groups(rows.where("n > 0"), groups, F.struct("doc_id", "content"), counts)
    size = F.col("n").alias("n_shingles")
    alone = rows.where("n = 0").select(
        "doc_id", size, F.col("doc_id").alias("component_id"),
        F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.select(
        "doc_id", size, F.col("least.doc_id").alias("component_id"),
        F.col("first.doc_id").alias("class_id"), "n_links").unionByName(alone)


def keep_first(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest doc_id,
    and all columns. Rows without words stay."""
    rows, groups, _ = similar_sets(docs, words, part, whole)
    linked = _with_groups(rows.where("n > 0"), groups, F.struct("doc_id", "content"))
    mine = F.struct("doc_id", "content")
    goes = linked.where(mine != F.col("least")).select(
        F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    goes = cut_lineage(goes, "near-duplicates")
    repeated = cut_lineage(
        linked.where(mine == F.col("least")).groupBy("doc_id", "content").count().where(
            "count > 1").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")),
        "repeated-rows")
    whole_rows = docs.select(F.struct("*").alias("_row"))
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (
        F.xxhash64(F.coalesce("_row.text", F.lit(""))) == F.col("_content"))
    kept = matched(whole_rows, goes, same, "left_anti", goes.count())
    twice = repeated.count()
    if not twice:
        return kept.select("_row.*")
    once = matched(kept, repeated, same, "left_anti", twice)
    several = matched(kept, repeated, same, "inner", twice)
    single = several.groupBy("_id", "_content").agg(F.first("_row").alias("_row"))
    return once.select("_row.*").unionByName(single.select("_row.*"))
