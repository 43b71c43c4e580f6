"""Exact search for the largest inner products, in columns, by branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import width
from quire.operators.skew import cut_lineage

TOP = 10
SCALE = 1024
STEP = 100          # rows whose id is divisible by it are queries
BLOCK = 4096        # candidates in a block
SHARE = 16          # blocks of candidates that a task holds while all queries pass
QUERIES = 256       # queries in a block
DIMENSIONS = 16     # dimensions in a step
EXACT = 2.0 ** 53
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

_BLOCK = "n int, rows binary, ids binary, small boolean, lines binary"
_NAMES = ["n", "rows", "ids", "small", "lines"]
_FOUND = "query long, query_id long, row long, vec_id long, score long, rough double"


def whole_parts(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a whole double; null if the vector takes no
    part: it is null, or holds a null, a NaN or an infinite component."""
    limit = F.lit(float("inf"))
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    whole = F.transform(embedding, lambda x: _floor(x.cast("double") * F.lit(float(scale))))
    return F.when(sound, whole)


def _floor(x: Column) -> Column:
    """Doubles from 2^52 on are whole already, and too large for the type of ``floor``."""
    return F.when(F.abs(x) < F.lit(2.0 ** 52), F.floor(x).cast("double")).otherwise(x)


class Columns:
    """A block of vectors in vertical layout: one line per dimension, with what the
    dimensions from any step on can still add at most (the norm of that rest)."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, lines: np.ndarray):
        self.rows, self.ids, self.lines = rows, ids, lines
        self.starts = list(range(0, max(len(lines), 1), DIMENSIONS))
        steps = [np.square(lines[at:at + DIMENSIONS]).sum(axis=0) for at in self.starts]
        rest = np.cumsum(np.array(steps)[::-1], axis=0)[::-1]
        # the bounds must not be below the truth by a rounding
        self.rest = [np.sqrt(part) * (1 + 1e-9) for part in rest[1:]]
        self.largest = float(np.abs(lines).sum(axis=0).max()) if lines.size else 0.0


class Best:
    """The best candidates of the queries of a block, and the score that must be reached."""

    def __init__(self, queries: Columns, top: int):
        self.queries, self.top = queries, top
        n = len(queries.rows)
        self.found = [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, at: int, scores: list, ids: np.ndarray, rows: np.ndarray) -> None:
        """Ties go to the smaller id. ``scores`` may hold whole numbers of any size."""
        merged = self.found[at] + list(zip([-s for s in scores], ids.tolist(), rows.tolist()))
        merged.sort()
        self.found[at] = merged[:self.top]
        if len(merged) >= self.top:
            self.least[at] = _double(-merged[self.top - 1][0])


def _double(whole: int) -> float:
    try:
        return float(whole)
    except OverflowError:
        return np.inf if whole > 0 else -np.inf


def visit(best: Best, block: Columns) -> None:
    """Every candidate of a block against every query of another.

    Inner products grow by steps of dimensions. After each step a candidate stays only while
    its product so far and the product of the two rests' norms reach some query's least
    score; the survivors' columns are compacted for the next step.
    """
    queries = best.queries
    if not len(block.rows) or not len(queries.rows):
        return
    if not queries.largest * block.largest < EXACT:
        return _visit_large(best, block)
    alive = np.arange(len(block.rows))
    sums = np.zeros((len(queries.rows), len(alive)))
    for step, at in enumerate(block.starts):
        part = slice(at, at + DIMENSIONS)
        sums += queries.lines[part].T @ block.lines[part][:, alive]
        if step < len(block.rest):
            most = sums + np.outer(queries.rest[step], block.rest[step][alive])
            stays = (most >= best.least[:, None]).any(axis=0)
            if not stays.all():
                alive, sums = alive[stays], sums[:, stays]
        if not len(alive):
            return
    ids, rows = block.ids[alive], block.rows[alive]
    for q in range(len(queries.rows)):
        good = np.flatnonzero((sums[q] >= best.least[q]) & (rows != queries.rows[q]))
        if len(good) > best.top:
            scores = sums[q][good]
            cut = np.partition(scores, len(scores) - best.top)[len(scores) - best.top]
            # of those at the cut the smallest ids are enough
            tied = good[scores == cut]
            tied = tied[np.argsort(ids[tied], kind="stable")[:best.top]]
            good = np.concatenate([good[scores > cut], tied])
        if len(good):
            best.add(q, sums[q][good].astype(np.int64).tolist(), ids[good], rows[good])


def _visit_large(best: Best, block: Columns) -> None:
    """Sums that doubles cannot hold exactly: whole numbers of any size, without a bound."""
    exact = [[int(x) for x in line] for line in block.lines.T]
    for q, vector in enumerate(best.queries.lines.T):
        numbers = [int(x) for x in vector]
        others = np.flatnonzero(block.rows != best.queries.rows[q])
        scores = [sum(a * b for a, b in zip(numbers, exact[i])) for i in others.tolist()]
        best.add(q, scores, block.ids[others], block.rows[others])


def _masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of squares of each dimension over the vectors of a task."""
    masses = np.zeros(0)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            wide = _wide(batch.column("whole").slice(at, BLOCK))
            here = np.square(wide).sum(axis=0)
            masses = np.pad(masses, (0, max(len(here) - len(masses), 0)))
            masses[:len(here)] += here
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(masses))), pa.array(masses)], ["dimension", "mass"])


def _wide(wholes: pa.Array, dimensions: int | None = None) -> np.ndarray:
    """Vectors as lines of one length; missing components of short ones are zeros."""
    lengths = np.diff(wholes.offsets.to_numpy())
    wide = np.zeros((len(lengths), lengths.max(initial=0) if dimensions is None else dimensions))
    wide[np.arange(wide.shape[1]) < lengths[:, None]] = wholes.flatten().to_numpy(False)
    return wide


def _packed(size: int, order: np.ndarray):
    """Rows (row, vec_id, whole) to blocks of ``size`` vectors, the dimensions in ``order``."""

    def block(rows: list, ids: list, wides: list) -> pa.RecordBatch:
        lines = np.concatenate(wides).T[order]
        small = bool(np.abs(lines).max(initial=0) < 2 ** 31)
        columns = [np.concatenate(rows), np.concatenate(ids),
                   lines.astype("<i4" if small else "<f8")]
        data = [pa.array([column.tobytes()], pa.binary()) for column in columns]
        return pa.RecordBatch.from_arrays(
            [pa.array([lines.shape[1]], pa.int32()), *data[:2], pa.array([small]), data[2]],
            _NAMES)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, wides, held = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, size - held)
                rows.append(some.column("row").to_numpy())
                ids.append(some.column("vec_id").to_numpy())
                wides.append(_wide(some.column("whole"), len(order)))
                at, held = at + some.num_rows, held + some.num_rows
                if held == size:
                    yield block(rows, ids, wides)
                    rows, ids, wides, held = [], [], [], 0
        if held:
            yield block(rows, ids, wides)

    return stage


def _columns(row: dict) -> Columns:
    kind = "<i4" if row["small"] else "<f8"
    lines = np.frombuffer(row["lines"], kind).reshape(-1, row["n"]).astype(np.float64)
    return Columns(np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["ids"], "<i8"), lines)


def _seeded(first: dict, top: int):
    """Adds to blocks of queries the scores that one block of candidates reaches already."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _columns(first)
        for batch in batches:
            for row in batch.to_pylist():
                best = Best(_columns(row), top)
                visit(best, block)
                yield pa.RecordBatch.from_pylist(
                    [row | {"least": best.least.astype("<f8").tobytes()}],
                    schema=pa.schema([*batch.schema, pa.field("least", pa.binary())]))

    return stage


def _search(top: int):
    """Per share the blocks of candidates come first and are held; blocks of queries follow."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["share"] != share:
                    share, held = row["share"], []
                if row["least"] is None:
                    held.append(_columns(row))
                    continue
                best = Best(_columns(row), top)
                best.least = np.frombuffer(row["least"], "<f8").copy()
                for block in held:
                    visit(best, block)
                yield _rows(best)

    return stage


def _rows(best: Best) -> pa.RecordBatch:
    queries = zip(best.queries.rows.tolist(), best.queries.ids.tolist(), best.found)
    out = [(query, query_id, row, vec_id, min(max(-low, LOWEST), HIGHEST), _double(-low))
           for query, query_id, found in queries for low, vec_id, row in found]
    columns = list(zip(*out)) or [()] * 6
    kinds = [pa.int64()] * 5 + [pa.float64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, kinds)],
        ["query", "query_id", "row", "vec_id", "score", "rough"])


def nearest(
    vectors: DataFrame, top: int = TOP, step: int = STEP, scale: int = SCALE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``vectors(vec_id, embedding)``
    whose vec_id is divisible by ``step``, the ``top`` rows with the largest inner product
    (all, if fewer), ties to the smaller vec_id; other columns are ignored.

    Components count as floor(scale * x). Every row but the query's own is a candidate:
    repeated rows are candidates of each other, and each repeated query has its own list.
    Rows without vec_id, and vectors that are null or hold a null or a component that is not
    finite, take no part. Missing components of shorter vectors are zeros. Sums beyond the
    doubles' exact range are computed in whole numbers; scores beyond 64 bits are given as
    the largest or smallest long and ranked as doubles. No vectors, no rows.

    Vectors are kept in blocks of columns, the dimensions with the largest mass first. A task
    holds one share of the blocks, at most ``SHARE``, while the blocks of queries pass by, so
    its memory does not depend on the table. Queries are copied once per share, as blocks;
    what goes to the driver is one block, which gives every query a first score to reach, and
    the masses of the dimensions.
    """
    spark = vectors.sparkSession
    own = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        whole_parts(F.col("embedding"), scale).alias("whole"),
    ).where("vec_id is not null and whole is not null")
    rows = cut_lineage(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    masses = rows.select("whole").mapInArrow(_masses, "dimension long, mass double").groupBy(
        "dimension").agg(F.sum("mass").alias("mass"))
    largest = masses.orderBy(F.desc("mass"), "dimension").collect()
    order = np.array([row["dimension"] for row in largest], np.int64)

    n = rows.count()
    parts = width(spark)
    shares = max(-(-n // (BLOCK * SHARE)), min(parts, -(-n // BLOCK)), 1)
    dealt = rows.select("row", "vec_id", "whole").repartition(shares)
    packed = dealt.mapInArrow(_packed(BLOCK, order), _BLOCK)
    blocks = cut_lineage(packed.select(
        F.spark_partition_id().alias("share"), *_NAMES, F.lit(None).cast("binary").alias("least"),
    ), "vector-blocks")
    first = blocks.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = rows.where(F.col("vec_id") % step == 0).select("row", "vec_id", "whole")
    queries = asked.mapInArrow(_packed(QUERIES, order), _BLOCK).mapInArrow(
        _seeded(first[0].asDict(), top), f"{_BLOCK}, least binary")
    copies = queries.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    met = blocks.unionByName(copies).repartitionById(shares, F.col("share"))
    found = met.sortWithinPartitions("share", F.col("least").isNotNull()).mapInArrow(
        _search(top), _FOUND)
    best = Window.partitionBy("query", "query_id").orderBy(
        F.desc("rough"), F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
