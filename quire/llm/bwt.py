"""Repeated strings of a fixed length by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

PACKED = 7  # symbols of nine bits in the first sort key
RANK_BITS = 21  # texts of fewer than two million symbols


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` (symbols below 512) in the order of their first ``depth``
    symbols or more; ties are left as they are. Only suffixes that are not yet alone are
    sorted again, by the rank of what follows."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(PACKED, np.uint64)])
    key = np.zeros(n, np.uint64)
    for step in range(PACKED):
        key = key << np.uint64(9) | padded[step:step + n]
    order = np.argsort(key)
    ranks = _ranks(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = ranks
    length = PACKED
    low = np.uint64((1 << RANK_BITS) - 1)
    while length < depth:
        alone = np.ones(n + 1, bool)
        alone[1:-1] = ranks[1:] != ranks[:-1]
        places = np.flatnonzero(~(alone[:-1] & alone[1:]))
        if not len(places):
            break
        suffix = order[places]
        following = np.minimum(suffix + length, n)
        behind = np.append(rank, -1)[following] + 1
        keys = (ranks[places].astype(np.uint64) << np.uint64(2 * RANK_BITS)
                | behind.astype(np.uint64) << np.uint64(RANK_BITS) | suffix.astype(np.uint64))
        keys.sort()
        order[places] = (keys & low).astype(np.int64)
        pairs = keys >> np.uint64(RANK_BITS)
        new = np.empty(len(places), bool)
        new[0] = True
        new[1:] = pairs[1:] != pairs[:-1]
        heads = np.maximum.accumulate(np.where(new, places, 0))
        ranks[places] = heads
        rank[order[places]] = heads
        length *= 2
    return order


def _ranks(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def prefix_groups(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For every place in the order of suffixes, whether its common prefix with the place
    before it is shorter than ``least``.

    Common prefixes are found by increasing length. Where a boundary of length l has just
    been found, each symbol's first occurrence in the transform between it and the next
    boundary leads, by one backward step, to a boundary of length l + 1, unless that place
    has a shorter one already. After ``least`` rounds it stops: what is left shares more.
    """
    n = len(text)
    last = text[order - 1]  # the transform; the first suffix has the last symbol before it
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    before = np.full(n, -1, np.int64)
    same = last[by_symbol][1:] == last[by_symbol][:-1]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n, bool)
    known[0] = True
    found = np.zeros(1, np.int64)
    for _ in range(least):
        bounds = np.flatnonzero(known)
        following = np.searchsorted(bounds, found, "right")
        ends = np.append(bounds, n)[following]
        sizes = ends - found
        shift = np.repeat(found - (np.cumsum(sizes) - sizes), sizes)
        places = shift + np.arange(len(shift))
        first = places[before[places] < np.repeat(found, sizes)]
        hit = step[first]
        hit = hit[~known[hit]]
        if not len(hit):
            break
        known[hit] = True
        hit.sort()
        found = hit
    return known


def repeated_windows(parts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each part, which of its strings of ``length`` bytes occur elsewhere in the parts,
    where a part counts ``weights`` times."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    text = data.astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    order = sorted_suffixes(text, length)
    group = np.cumsum(prefix_groups(text, order, length)) - 1
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    starts = np.flatnonzero(np.arange(len(text)) + length <= ends[owner])
    of_suffix = np.empty(len(text), np.int64)
    of_suffix[order] = group
    weight = np.asarray(weights, np.int64)[owner[starts]]
    total = np.bincount(of_suffix[starts], weights=weight, minlength=int(group[-1]) + 1)
    found = total[of_suffix[starts]] >= 2
    counts = np.maximum(sizes - length + 1, 0)
    return np.split(found, np.cumsum(counts)[:-1])
