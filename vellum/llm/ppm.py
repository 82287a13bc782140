"""Prediction by partial matching over byte contexts: the trie as sorted arrays.

A gram is ``order`` context bytes and the symbol that follows, packed into 64 bits. Level k of
the trie holds what the last k context bytes and the symbol add up to. A probability is found
from the longest context downwards: a symbol seen n times of T there has (2n - 1) / 2T, and
q / 2T is left for an escape, where q symbols have been seen (method D). After an escape the
symbols of the longer context are excluded. They are all seen in the shorter context too, so
the exclusion only takes sums off T and q. Below the empty context all symbols left are equal.
"""

from __future__ import annotations

import numpy as np

#: Bytes that UTF-8 never uses: what stands in front of a text, and what ends it.
START, END = 0xFE, 0xFF
ALPHABET = 255


def grams(text: bytes, order: int) -> np.ndarray:
    """The gram of every byte of a text and of its end."""
    s = np.frombuffer(bytes([START]) * order + text + bytes([END]), np.uint8)
    n = len(text) + 1
    out = np.zeros(n, np.uint64)
    for j in range(order + 1):
        out = (out << np.uint64(8)) | s[j : j + n].astype(np.uint64)
    return out


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs (or its summed weights)."""
    if weights is None:
        values = np.sort(values)
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        return values[first], np.diff(np.append(first, len(values)))
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


class Level:
    """Grams of one context length with their counts (0 for grams only asked for), sorted."""

    def __init__(self, values: np.ndarray, n: np.ndarray):
        self.values, self.n = values, n.astype(np.int64)
        contexts = values >> np.uint64(8)
        self.context = np.cumsum(np.concatenate([[0], contexts[1:] != contexts[:-1]])) if len(values) else np.zeros(0, np.int64)
        size = int(self.context[-1]) + 1 if len(values) else 0
        self.total = np.bincount(self.context, weights=self.n, minlength=size).astype(np.int64)
        self.seen = np.bincount(self.context, weights=self.n > 0, minlength=size).astype(np.int64)

    def shorter(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and counts with only the last ``length`` context bytes."""
        return counted(self.values & np.uint64((1 << (8 * (length + 1))) - 1), self.n)


def log10_probabilities(values: np.ndarray, n: np.ndarray, order: int, low: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of each gram's probability.

    ``values``, ``n``: distinct sorted grams and training counts, complete for the contexts that
    end like theirs in ``max(low) + 1`` bytes. ``low``: values and counts of the shortest levels.
    """
    levels = {order: Level(values, n)}
    for k in range(order - 1, -1, -1):
        levels[k] = Level(*low[k]) if k in low else Level(*levels[k + 1].shorter(k))
    out = np.zeros(len(values))
    open_ = np.arange(len(values))  # grams whose symbol hasn't been found yet
    asked = values.copy()
    above: Level | None = None
    above_context = np.zeros(0, np.int64)
    for k in range(order, -1, -1):
        level = levels[k]
        key = asked[open_] & np.uint64((1 << (8 * (k + 1))) - 1)
        at = np.searchsorted(level.values, key)
        context = level.context[at]
        total, seen = level.total[context], level.seen[context]
        if above is not None:
            # what the longer context has seen is excluded here
            down = np.searchsorted(level.values, above.values & np.uint64((1 << (8 * (k + 1))) - 1))
            there = np.bincount(above.context, weights=np.where(above.n > 0, level.n[down], 0), minlength=len(above.total)).astype(np.int64)
            total, seen = total - there[above_context], seen - above.seen[above_context]
        count = level.n[at]
        hit = count > 0
        out[open_[hit]] += np.log10((2 * count[hit] - 1) / (2 * total[hit]))
        miss = ~hit
        escapes = miss & (total > 0)
        out[open_[escapes]] += np.log10(seen[escapes] / (2 * total[escapes]))
        open_, above, above_context = open_[miss], level, context[miss]
    left = ALPHABET - above.seen[above_context] if above is not None else ALPHABET
    out[open_] -= np.log10(left)
    return out
