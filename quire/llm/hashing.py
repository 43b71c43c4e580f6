"""Vectorised hashes of words and shingles over many texts at once."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
BASE = np.uint64(0x100000001B3)
BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_known_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def power(base: np.uint64, n: int) -> np.ndarray:
    name = str(base)
    known = _known_powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 8 << 20:
            _known_powers[name] = known
    return known[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, letters A-Z in lower case, and how many words
    each text has. Equal words have equal hashes wherever they stand."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[data]
    before = np.empty(len(space), bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = (data.astype(np.uint64) + np.uint64(1)) * power(BASE, len(data))
    np.cumsum(values, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * power(BASE_INVERSE, len(data))[starts]
    hashes = mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(_ODD))
    bounds = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(starts, bounds, "left"), prepend=0)
    return hashes, counts


def shingle_hashes(
    words: np.ndarray, counts: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, in order, and how many each text
    has. A text with fewer words has one, of the whole sequence; without words it has none."""
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    n = np.cumsum(number)
    total = int(n[-1]) if len(n) else 0
    place = np.repeat(first - (n - number), number) + np.arange(total)
    length = np.repeat(np.minimum(counts, size), number)
    found = length.astype(np.uint64) * np.uint64(_ODD)
    for step in range(size):
        inside = step < length
        word = words[np.minimum(place + step, max(len(words) - 1, 0))] if total else found
        found = np.where(inside, (found + word) * _STEP ^ (found >> np.uint64(29)), found)
    return mixed(found), number
