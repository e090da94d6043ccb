"""Alignments of two sequences in little memory: longest common subsequences, and pairings in order of the greatest likeness.

A table of the best value from each cell to the end is made row by row from below, a row at a time with numpy; what is kept is one row.
The way through it runs from above. So the rows are halved: the middle row is made first, then the way is found in the upper
half and after it in the lower one, each from the row below it. That takes memory in proportion to a row and time in proportion to the
table, times the number of halvings; no size switches anything off.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np

#: Decisions, one byte each, that a part of a table may hold at once.
CELLS = 4_000_000
RIGHT, DOWN, TAKE = 0, 1, 2

#: ``step(i, row)`` turns the values of row i + 1 into those of row i, in place; it returns the first column that it touched and the
#: decision in each from there on. Where it touches nothing, ``row`` keeps values that can be reached, if not the best.
Step = Callable[[int, np.ndarray], tuple[int, np.ndarray]]


def way(rows: int, columns: int, step: Step, bottom: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Cells (row, column) that the best way from the upper left takes."""

    def within(first: int, last: int, below: np.ndarray, j: int) -> Iterator[tuple[int, int]]:
        if (last - first) * width > CELLS and last - first > 1:
            middle = (first + last) // 2
            row = below.copy()
            for i in range(last - 1, middle - 1, -1):
                step(i, row)
            j = yield from within(first, middle, row, j)
            return (yield from within(middle, last, below, j))
        row = below.copy()
        told = [step(i, row) for i in range(last - 1, first - 1, -1)][::-1]
        i = first
        while i < last and j < columns:
            start, choice = told[i - first]
            move = choice[j - start]
            if move == TAKE:
                yield i, j
            i, j = i + (move != RIGHT), j + (move != DOWN)
        return j

    yield from within(0, rows, bottom, 0)


def swept(values: np.ndarray, right: float) -> tuple[np.ndarray, np.ndarray]:
    """Each value or the greatest to its right, ``right`` included; and what stands one to the right of each."""
    values[-1] = max(values[-1], right)
    best = np.maximum.accumulate(values[::-1])[::-1]
    return best, np.append(best[1:], right)


def common_step(x: np.ndarray, y: np.ndarray, slack: int) -> Step:
    """Rows of the table of common subsequences, within ``slack`` of the diagonals between both corners."""
    low, high = min(0, len(y) - len(x)) - slack - 1, max(0, len(y) - len(x)) + slack + 1

    def step(i: int, row: np.ndarray) -> tuple[int, np.ndarray]:
        a, b = max(0, i + low), min(len(y), i + high + 1)
        if a >= b:
            return a, np.empty(0, np.int8)
        same = y[a:b] == x[i]
        below = row[a:b].copy()
        best, right = swept(np.where(same, row[a + 1 : b + 1] + 1, below), row[b])
        row[a:b] = best
        return a, np.where(same, TAKE, np.where(below >= right, DOWN, RIGHT)).astype(np.int8)

    return step


def without_ends(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray, int, list[tuple[int, int]]]:
    """The pairs that ``common`` takes at the beginning, what is left of both sides (of ``x`` with its positions, of ``y`` with its first one),
    and the pairs at the end.

    Equal first elements always match. So do an element that occurs once in ``x`` and its like that comes first in ``y`` but for what ``x``
    lacks; with several in ``x`` a later one might be meant. Equal last elements always match if they occur once on both sides, as no
    longest sequence could do without them.
    """
    n, least = 0, min(len(x), len(y))
    while n < least and x[n] == y[n]:
        n += 1
    head, tail = [(k, k) for k in range(n)], []
    # What only x has is left out at once, wherever the way is.
    kept = np.flatnonzero(np.isin(x[n:], y[n:])) + n
    u, v = x[kept].tolist(), y[n:].tolist()
    in_x, in_y = Counter(u), Counter(v)
    i, j, p, q = 0, 0, len(u), len(v)
    while i < p:
        k = j
        while k < q and v[k] not in in_x:
            k += 1
        if k == q or u[i] != v[k] or (k > j and in_x[u[i]] > 1):
            break
        head.append((int(kept[i]), n + k))
        i, j = i + 1, k + 1
    while i < p:
        while q > j and v[q - 1] not in in_x:
            q -= 1
        if q == j or u[p - 1] != v[q - 1] or in_x[u[p - 1]] > 1 or in_y[v[q - 1]] > 1:
            break
        p, q = p - 1, q - 1
        tail.append((int(kept[p]), n + q))
    return head, x[kept[i:p]], y[n + j : n + q], kept[i:p], n + j, tail[::-1]


def common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence: of those, the one that matches as early as it can, and otherwise leaves out of ``x`` first.

    A way with d elements left out lies within (d - difference in length) / 2 of the diagonals between both corners. So a narrow table
    serves first; it is the whole truth once the way found in it is no longer than its width admits, else it is widened twofold.
    What must be matched at either end needs no table.
    """
    head, x, y, kept, n, tail = without_ends(x, y)
    if not len(x) or not len(y):
        return head + tail
    slack = 8
    while True:
        step, row = common_step(x, y, slack), np.zeros(len(y) + 1, np.int32)
        for i in range(len(x) - 1, -1, -1):
            step(i, row)
        left_out = len(x) + len(y) - 2 * int(row[0])
        if left_out - abs(len(x) - len(y)) <= 2 * slack:
            break
        slack *= 2
    width = min(len(y), abs(len(y) - len(x)) + 2 * slack + 3)
    return head + [(int(kept[i]), n + j) for i, j in way(len(x), len(y), step, np.zeros(len(y) + 1, np.int32), width)] + tail


class Likeness:
    """How alike each of ``old`` is to each of ``new``, bags of word numbers: words in common over the larger bag, a row at a time."""

    def __init__(self, old: list[np.ndarray], new: list[np.ndarray]):
        self.old = [np.unique(bag, return_counts=True) for bag in old]
        self.old_sizes, self.sizes = [len(b) for b in old], np.array([len(b) for b in new])
        words, counts = zip(*[np.unique(bag, return_counts=True) for bag in new], strict=True) if new else ((), ())
        owner = np.repeat(np.arange(len(new)), [len(w) for w in words])
        word = np.concatenate(words) if new else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        self.word, self.owner, self.count = word[order], owner[order], (np.concatenate(counts) if new else word)[order]

    def row(self, i: int) -> np.ndarray:
        words, counts = self.old[i]
        begin, end = np.searchsorted(self.word, words), np.searchsorted(self.word, words, side="right")
        n = end - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], np.minimum(self.count[at], np.repeat(counts, n)), len(self.sizes))
        return shared / np.maximum(np.maximum(self.sizes, self.old_sizes[i]), 1)


def pairing(like: Likeness, rows: int, columns: int, least: float) -> list[tuple[int, int]]:
    """Pairs in order, each at least ``least`` alike, of the greatest likeness in all; a pair before none, then ``old`` left out first."""

    def step(i: int, row: np.ndarray) -> tuple[int, np.ndarray]:
        alike, below = like.row(i), row[:-1].copy()
        paired = np.where(alike >= least, alike + row[1:], -1.0)
        best, right = swept(np.maximum(paired, below), 0.0)
        row[:-1] = best
        return 0, np.where((alike >= least) & (best == paired), TAKE, np.where(below >= right, DOWN, RIGHT)).astype(np.int8)

    return list(way(rows, columns, step, np.zeros(columns + 1), columns)) if rows and columns else []
