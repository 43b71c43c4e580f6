"""Links between sets of numbers above a Jaccard similarity, by a trie of ordered sets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(slots=True)
class Node:
    """A run of numbers that the sets ``lo..hi`` of the sorted list share after ``start``;
    those up to ``own`` end with it."""

    run: np.ndarray
    end: int
    lo: int
    own: int
    hi: int
    shortest: int
    longest: int
    below: list[Node] = field(default_factory=list)


def _build(sets: list[np.ndarray]) -> Node:
    """Compressed trie of lexicographically sorted sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    root = Node(np.zeros(0, np.int64), 0, 0, 0, len(sets), int(sizes.min()), int(sizes.max()))
    while root.own < len(sets) and not len(sets[root.own]):
        root.own += 1
    waiting = [root]
    while waiting:
        node = waiting.pop()
        lo = node.own
        while lo < node.hi:
            value, hi = sets[lo][node.end], lo + 1
            while hi < node.hi and sets[hi][node.end] == value:
                hi += 1
            first, last = sets[lo][node.end:], sets[hi - 1][node.end:]
            n = min(len(first), len(last))
            differ = first[:n] != last[:n]
            shared = int(differ.argmax()) if differ.any() else n
            end, own = node.end + shared, lo
            while own < hi and sizes[own] == end:
                own += 1
            some = sizes[lo:hi]
            child = Node(first[:shared], end, lo, own, hi, int(some.min()), int(some.max()))
            node.below.append(child)
            if own < hi:
                waiting.append(child)
            lo = hi
    return root


def needed(x: int, y: int, part: int, whole: int) -> int:
    """The least overlap of sets of these sizes with whole * overlap >= part * union."""
    return -(-part * (x + y) // (part + whole))


def _in_order(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as ranks, sorted, the frequent numbers first, and how many numbers there are."""
    every = np.concatenate(sets)
    values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    bounds = np.cumsum([len(s) for s in sets])
    return [np.sort(part) for part in np.split(rank[inverse], bounds[:-1])], len(values)


def _by_key(ordered: list[np.ndarray]) -> list[int]:
    keys = [s.astype(">u4").tobytes() for s in ordered]
    return sorted(range(len(ordered)), key=keys.__getitem__)


class _Index:
    """The trie of sorted sets as arrays, level by level, and the sets by their rare numbers."""

    def __init__(self, ordered: list[np.ndarray], size: int, part: int, whole: int):
        self.part, self.whole, self.count = part, whole, len(ordered)
        levels = [[_build(ordered)]]
        while any(node.below for node in levels[-1]):
            levels.append([child for node in levels[-1] for child in node.below])
        self.depth = len(levels)
        nodes = [node for level in levels for node in level]
        self.runs = np.concatenate([node.run for node in nodes])
        self.stop = np.cumsum([len(node.run) for node in nodes])
        self.start = self.stop - [len(node.run) for node in nodes]
        self.last = np.array([node.run[-1] if len(node.run) else -1 for node in nodes])
        self.end, self.lo, self.own, self.hi, self.shortest, self.longest = np.array(
            [(n.end, n.lo, n.own, n.hi, n.shortest, n.longest) for n in nodes]).T
        below = np.array([len(node.below) for node in nodes])
        self.below, self.child = below, 1 + np.cumsum(below) - below
        rare = [self.rare(numbers) for numbers in ordered]
        numbers = np.concatenate(rare)
        whose = np.repeat(np.arange(len(ordered)), [len(r) for r in rare])
        self.sets = whose[np.argsort(numbers, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=size))])
        self.mark = np.zeros(size, bool)

    def rare(self, numbers: np.ndarray) -> np.ndarray:
        """The rarest numbers of a set, of which any similar set has one among its own."""
        n = len(numbers)
        return numbers[-(-self.part * n // self.whole) - 1:] if n else numbers

    def candidates(self, probe: np.ndarray) -> np.ndarray:
        """The sets that share one of the rare numbers, in order."""
        rare = self.rare(probe)
        return np.unique(self.sets[_ranges(self.first[rare], self.first[rare + 1])])

    def similar(self, probe: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Those of the sets ``wanted`` that are similar to the probe.

        The walk goes down one level at a time and carries, for every branch, the overlap
        with the path, which all sets below share. It leaves a branch without wanted sets,
        and one where the most that can still be shared, by what is left of the probe and
        of the sets below, is too little for any of them.
        """
        held = np.zeros(self.count + 1, np.int64)
        held[wanted + 1] = 1
        asked, held = held[1:].astype(bool), np.cumsum(held)
        self.mark[probe] = True
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        for _ in range(self.depth):
            start, stop, end = self.start[nodes], self.stop[nodes], self.end[nodes]
            sums = np.concatenate([[0], np.cumsum(self.mark[self.runs[_ranges(start, stop)]])])
            after = np.cumsum(stop - start)
            overlap = overlap + sums[after] - sums[after - (stop - start)]
            rest = len(probe) - np.searchsorted(probe, self.last[nodes], "right")
            best = np.clip(end + rest, self.shortest[nodes], self.longest[nodes])
            most = overlap + np.minimum(best - end, rest)
            enough = most >= needed(len(probe), best, self.part, self.whole)
            here = nodes[overlap >= needed(len(probe), end, self.part, self.whole)]
            found.append(_ranges(self.lo[here], self.own[here]))
            nodes, overlap = nodes[enough], overlap[enough]
            overlap = np.repeat(overlap, self.below[nodes])
            nodes = _ranges(self.child[nodes], self.child[nodes] + self.below[nodes])
            some = held[self.hi[nodes]] > held[self.lo[nodes]]
            nodes, overlap = nodes[some], overlap[some]
            if not len(nodes):
                break
        self.mark[probe] = False
        every = np.concatenate(found)
        return np.sort(every[asked[every]])


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    lengths = stops - starts
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def links(
    sets: list[np.ndarray], part: int, whole: int,
    labels: np.ndarray | None = None, probes: list[int] | None = None,
) -> list[tuple[int, int]]:
    """Pairs of similar sets that join all sets which similarity connects.

    ``sets`` have distinct numbers each and are not empty. With ``probes``, only pairs of
    one of those with any set are looked for. Sets of one label count as connected already.
    Numbers are put in one order, the frequent ones first, and the sets into a trie, which a
    probe walks from the root (``_Index.similar``). The sets it looks for are those that
    share a rare number with it, in a range that similar sets must, and are not connected
    with it.
    """
    if len(sets) < 2:
        return []
    ordered, size = _in_order(sets)
    by_key = _by_key(ordered)
    ordered = [ordered[i] for i in by_key]
    label = np.arange(len(sets)) if labels is None else np.asarray(labels)[by_key].copy()
    place = {old: new for new, old in enumerate(by_key)}
    index, found = _Index(ordered, size, part, whole), []
    for x in range(len(sets)) if probes is None else [place[p] for p in probes]:
        wanted = index.candidates(ordered[x])
        wanted = wanted[label[wanted] != label[x]]
        if probes is None:
            wanted = wanted[wanted > x]  # the others looked at this one
        if not len(wanted):
            continue
        for y in index.similar(ordered[x], wanted).tolist():
            if label[y] != label[x]:
                found.append((by_key[x], by_key[y]))
                label[label == label[y]] = label[x]
    return found


def link_counts(
    sets: list[np.ndarray], part: int, whole: int, probes: list[int] | None = None
) -> np.ndarray:
    """How many of the others each set is similar to, whatever is connected already.

    ``sets`` are different, not empty, and have distinct numbers each. With ``probes``, only
    pairs of one of those with one of the others count, and the trie holds the others. The
    walk is that of ``links``, for all sets that share a rare number with the probe.
    """
    counts = np.zeros(len(sets), np.int64)
    asked = list(range(len(sets))) if probes is None else probes
    aside = set() if probes is None else set(probes)
    inside = [i for i in range(len(sets)) if i not in aside]
    if not asked or not inside:
        return counts
    ordered, size = _in_order(sets)
    by_key = np.array([inside[i] for i in _by_key([ordered[i] for i in inside])])
    index = _Index([ordered[i] for i in by_key], size, part, whole)
    for x in asked:
        wanted = index.candidates(ordered[x])
        wanted = wanted[by_key[wanted] != x]
        if probes is None:
            wanted = wanted[by_key[wanted] > x]  # the others looked at this one
        similar = by_key[index.similar(ordered[x], wanted)] if len(wanted) else by_key[:0]
        counts[x] += len(similar)
        counts[similar] += 1
    return counts
