"""Counts gathered in a task before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class Tally:
    """Counts of 64-bit values in a task; given out whenever too many are held."""

    def __init__(self, limit: int = 3_000_000):
        self.limit, self.key, self.n, self.new = limit, np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, values: np.ndarray) -> None:
        self.add_counts(*np.unique(values, return_counts=True))

    def add_counts(self, key: np.ndarray, n: np.ndarray) -> None:
        self.new.append((key, n))
        if sum(len(k) for k, _ in self.new) > 1_000_000:
            self._fold()

    def _fold(self) -> None:
        key = np.concatenate([self.key, *(k for k, _ in self.new)])
        n = np.concatenate([self.n, *(c for _, c in self.new)])
        self.new = []
        if len(key):
            self.key, at = np.unique(key, return_inverse=True)
            self.n = np.bincount(at, weights=n).astype(np.int64)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Every value in order, and its count."""
        self._fold()
        return self.key, self.n

    def take(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if least:
            if len(self.key) < least:
                return
        else:
            self._fold()
        for lo in range(0, len(self.key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(self.key[lo:lo + 100_000].view(np.int64)), pa.array(self.n[lo:lo + 100_000])], names=["gram", "n"])
        self.key, self.n = self.key[:0], self.n[:0]
