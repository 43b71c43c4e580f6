"""Counts of word windows in a trie of word numbers with burstable hash containers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = 4            # bytes of a word number
WINDOW = 4 * WORD   # a window: its first word and the three that follow, 0 where there is none
BURST = 4096
MOST = 300_000


class HatTrie:
    """Windows of four word numbers, counted.

    The trie goes from word to word; below a node that is not split lies one hash container
    with the rest of each window and its count. A container above ``burst`` entries bursts
    into one container per next word. When the trie holds more than ``most`` windows, whole
    subtrees of first words leave it as sorted runs, the largest first, until half is left:
    small subtrees, which cost little, go on collecting.
    """

    def __init__(self, burst: int = BURST, most: int = MOST):
        self.burst, self.most = burst, most
        self.root: dict[bytes, dict | Branch] = {}
        self.sizes: dict[bytes, int] = {}
        self.entries = 0

    def add(self, windows: list[bytes], counts: list[int]) -> None:
        for window, count in zip(windows, counts):
            word = window[:WORD]
            node = self.root.get(word)
            if node is None:
                node = self.root[word] = {}
                self.sizes[word] = 0
            at = WORD
            holder, last = self.root, word
            while type(node) is Branch:
                holder, last = node.children, window[at:at + WORD]
                at += WORD
                node = holder.get(last)
                if node is None:
                    node = holder[last] = {}
            rest = window[at:]
            before = node.get(rest)
            if before is not None:
                node[rest] = before + count
                continue
            node[rest] = count
            self.sizes[word] += 1
            self.entries += 1
            if len(node) > self.burst and at < WINDOW - WORD:
                holder[last] = Branch(node)

    def spill(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Subtrees as sorted runs, until at most half of ``most`` is left."""
        if self.entries <= self.most:
            return
        for word in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= self.most // 2:
                return
            yield self.take(word)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for word in sorted(self.root):
            yield self.take(word)

    def take(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The sorted windows of a subtree, as pairs of big-endian halves, and their counts;
        the subtree is gone."""
        self.entries -= self.sizes.pop(word)
        found = sorted(_entries(self.root.pop(word), word))
        windows = np.frombuffer(b"".join(window for window, _ in found), ">i8").reshape(-1, 2)
        return windows, np.fromiter((count for _, count in found), np.int64, len(found))


class Branch:
    """A node that has burst: a container, or another branch, per next word."""

    def __init__(self, container: dict[bytes, int]):
        self.children: dict[bytes, dict | Branch] = {}
        for rest, count in container.items():
            self.children.setdefault(rest[:WORD], {})[rest[WORD:]] = count


def _entries(node: dict | Branch, path: bytes) -> Iterator[tuple[bytes, int]]:
    if type(node) is Branch:
        for word, child in node.children.items():
            yield from _entries(child, path + word)
    else:
        for rest, count in node.items():
            yield path + rest, count
