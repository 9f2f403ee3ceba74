"""The words of many texts as arrays of code points, so that automata and forward sums run over all of them at once."""

from __future__ import annotations

import sys
from copy import copy

import numpy as np


class Letters:
    """Which code points belong to words; the table is made once per process."""

    def __init__(self, digits: bool):
        self.digits = digits
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return {"digits": self.digits, "table": None}

    def __call__(self, points: np.ndarray) -> np.ndarray:
        if self.table is None:
            test = str.isalnum if self.digits else str.isalpha
            self.table = np.fromiter((test(chr(c)) for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        return self.table[points]


class WordGrid:
    """Runs of letters of lower-cased texts: ``points`` of all texts in a row, and ``start``, ``length`` and ``doc`` of each word."""

    def __init__(self, texts: list[str | None], letters: Letters, longest: int | None = None):
        low = [(t or "").lower() for t in texts]
        self.points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in low])
        inside = np.concatenate(([False], letters(self.points), [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, length = edges[0::2], edges[1::2] - edges[0::2]
        if longest and len(length) and length.max() > longest:
            parts = -(-length // longest)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, length = np.repeat(start, parts) + nth * longest, np.minimum(np.repeat(length, parts) - nth * longest, longest)
        self.start, self.length = start, length
        self.doc = np.searchsorted(ends, start, side="right")
        self.docs = len(texts)
        self.words = np.bincount(self.doc, minlength=self.docs)

    def only(self, chosen: np.ndarray) -> "WordGrid":
        """The same texts with some of their words."""
        out = copy(self)
        out.start, out.length, out.doc = self.start[chosen], self.length[chosen], self.doc[chosen]
        out.words = np.bincount(out.doc, minlength=out.docs)
        return out
