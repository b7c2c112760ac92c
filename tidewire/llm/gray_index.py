"""Codes in Gray order under a hierarchy of shared bit patterns, searched by accumulated differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN = 16  # children of a node
FRONTIER = 1_000_000  # pairs of nodes looked at together
BLOCKS = 8_000  # pairs of leaf blocks compared together


def gray_rank(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of 128-bit codes in the Gray sequence, as two words."""
    high, low = high.copy(), low.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        high ^= high >> np.uint64(shift)
        low ^= low >> np.uint64(shift)
    low[(high & np.uint64(1)) == 1] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
    return high, low


def gray_order(key: np.ndarray, high: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """Rows by key, then by Gray rank; without ``low`` codes are single words."""
    if low is None:
        return np.lexsort((gray_rank(high, np.zeros_like(high))[0], key))
    top, rest = gray_rank(high, low)
    return np.lexsort((rest, top, key))


class GrayForest:
    """One tree for each key over codes that are sorted by :func:`gray_order`.

    A node covers up to FAN neighbours of one key. ``same`` marks the bits on which all codes below agree, ``bits`` their values. The
    search goes down with pairs of nodes: their differences on the bits that both have settled are a lower bound for every pair of codes below, and
    grow as more bits settle; beyond the limit both groups part, with everything below. Codes are compared one by one in pairs of lowest nodes only.
    Rows of one ``label`` (0 is none) are known to belong together: their pairs aren't asked for, and nodes that hold one label only aren't opened for each other.
    """

    def __init__(self, key: np.ndarray, high: np.ndarray, low: np.ndarray | None = None, label: np.ndarray | None = None):
        self.key = key
        self.label = np.zeros(len(key), np.int64) if label is None else label
        self.labels: list[np.ndarray] = []  # of each node: the label all rows below have, or 0
        self.codes = high[:, None] if low is None else np.stack([high, low], axis=1)
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        same, bits, keys, label = np.full(self.codes.shape, every), self.codes, key, self.label
        self.levels: list[tuple] = []  # from the lowest nodes up: mask of settled bits, their values, first child, one past the last
        while len(keys):
            m = len(keys)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            if len(starts) == m and self.levels:
                break
            place = np.arange(m) - np.repeat(starts, np.diff(np.r_[starts, m]))
            begin = np.flatnonzero(place % FAN == 0)
            ones = np.bitwise_and.reduceat(bits & same, begin, axis=0)
            zeros = np.bitwise_and.reduceat(same & ~bits, begin, axis=0)
            same, bits = ones | zeros, ones
            self.levels.append((same, bits, begin, np.r_[begin[1:], m]))
            low_label = np.minimum.reduceat(label, begin)
            label = np.where(low_label == np.maximum.reduceat(label, begin), low_label, 0)
            self.labels.append(label)
            keys = keys[begin]

    def self_pairs(self, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of rows of one key at most ``limit`` bits apart: places (smaller first) and distances."""
        found = list(self.pairs_in_turn(limit))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def pairs_in_turn(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same, some blocks at a time, so that the pairs of large groups need not be held together."""
        if not self.levels:
            return
        top = len(self.levels) - 1
        size = self.levels[top][3] - self.levels[top][2]
        roots = np.flatnonzero(self.labels[top] == 0)
        roots = roots[size[roots] > 1] if top == 0 else roots
        todo = [(top, roots[at : at + FRONTIER], roots[at : at + FRONTIER]) for at in range(0, len(roots), FRONTIER)]
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                for at in range(0, len(a), BLOCKS):
                    yield self._compare(a[at : at + BLOCKS], b[at : at + BLOCKS], limit)
                continue
            _, _, begin, end = self.levels[level]
            wide, high = end[a] - begin[a], end[b] - begin[b]
            count = wide * high
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(count) // FRONTIER)) + 1):
                c = count[part]
                total = int(c.sum())
                if not total:
                    continue
                nth = np.arange(total) - np.repeat(np.r_[0, c.cumsum()[:-1]], c)
                h = np.repeat(high[part], c)
                x, y = np.repeat(begin[a[part]], c) + nth // h, np.repeat(begin[b[part]], c) + nth % h
                mine = self.labels[level - 1]
                keep = (x <= y) & ((mine[x] == 0) | (mine[x] != mine[y]))
                x, y = x[keep], y[keep]
                near = self._differences(x, y, level - 1) <= limit
                todo.append((level - 1, x[near], y[near]))

    def _differences(self, x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
        same, bits = self.levels[level][0], self.levels[level][1]
        return np.bitwise_count((bits[x] ^ bits[y]) & same[x] & same[y]).sum(axis=1, dtype=np.int64)

    def _compare(self, a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, _, begin, end = self.levels[0]
        wide = int(max((end[a] - begin[a]).max(initial=1), (end[b] - begin[b]).max(initial=1)))
        step = np.arange(wide)
        p, q = begin[a][:, None] + step, begin[b][:, None] + step
        last = len(self.key) - 1
        differ = np.zeros((len(a), wide, wide), np.uint8)
        for w in range(self.codes.shape[1]):
            word = self.codes[:, w]
            differ += np.bitwise_count(word[np.minimum(p, last)][:, :, None] ^ word[np.minimum(q, last)][:, None, :])
        hit, i, j = np.nonzero(differ <= limit)
        x, y = p[hit, i], q[hit, j]
        keep = (x < y) & (x < end[a[hit]]) & (y < end[b[hit]])
        keep[keep] = (self.label[x[keep]] == 0) | (self.label[x[keep]] != self.label[y[keep]])
        return x[keep], y[keep], differ[hit[keep], i[keep], j[keep]].astype(np.int64)
