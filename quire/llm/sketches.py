"""Bitmaps of sets that bound from below in how many numbers two sets differ."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quire.llm.arrow import rows_of
from quire.llm.hashing import mixed
from quire.llm.trie import needed

LEAST_BITS = 512


def sketch(numbers: np.ndarray) -> np.ndarray:
    """Parities of how many numbers fall on each bit, of two to four bits a number.

    Where two sets share a number it changes the same bit of both, so their bitmaps differ
    in as many bits as the sets differ in numbers, at most. Sets that have little in common
    differ in nearly half of all bits.
    """
    size = max(LEAST_BITS, 1 << (2 * len(numbers) - 1).bit_length())
    place = (mixed(numbers) & np.uint64(size - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with fewer bits."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def near(
    sizes: np.ndarray, sketches: list[np.ndarray], part: int, whole: int,
    side: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Pairs that join all sets which chains of pairs connect, where a pair counts if its
    sketches do not rule out that whole * intersection >= part * union. With ``side``, only
    pairs from one side to the other count."""
    order = np.argsort(sizes, kind="stable")
    sizes = np.asarray(sizes, np.int64)[order]
    words = min(map(len, sketches))
    table = np.stack([folded(sketches[i], words) for i in order])
    # unrelated sets differ too much in the first half already
    first, second = table[:, :words // 2].copy(), table[:, words // 2:].copy()
    apart = None if side is None else np.asarray(side)[order]
    label, found = np.arange(len(sizes)), []
    for x in range(len(sizes) - 1):
        stop = np.searchsorted(part * sizes, whole * sizes[x], "right")
        asked = label[x + 1:stop] != label[x]
        if apart is not None:
            asked &= apart[x + 1:stop] != apart[x]
        others = x + 1 + np.flatnonzero(asked)
        if not len(others):
            continue
        most = sizes[x] + sizes[others] - 2 * needed(sizes[x], sizes[others], part, whole)
        differ = np.bitwise_count(first[others] ^ first[x]).sum(1, dtype=np.int64)
        some = differ <= most
        others, most, differ = others[some], most[some], differ[some]
        differ += np.bitwise_count(second[others] ^ second[x]).sum(1, dtype=np.int64)
        for y in others[differ <= most].tolist():
            if label[y] != label[x]:
                found.append((int(order[x]), int(order[y])))
                label[label == label[y]] = label[x]
    return found


def near_stage(part: int, whole: int):
    """Edges among the sets of each group; groups come one after the other. A row is
    (key, cross, side, brief, n, sketch); in a group that is cross, only pairs of different
    sides count."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(group: list[tuple]) -> pa.RecordBatch:
        _, cross, side, briefs, sizes, bits = zip(*group)
        pairs = near(np.array(sizes), [np.frombuffer(b, "<u8") for b in bits], part, whole,
                     np.array(side) if cross[0] else None)
        return pa.RecordBatch.from_arrays(
            [pa.array([briefs[a] for a, _ in pairs], pa.int64()),
             pa.array([briefs[b] for _, b in pairs], pa.int64())], schema=schema)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for row in rows_of(batches):
            if group and row[0] != group[0][0]:
                yield found(group)
                group = []
            group.append(row)
        if group:
            yield found(group)

    return stage
