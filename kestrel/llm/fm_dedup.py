"""Substring dedup: repeated word runs through one compressed FM-index per shard.

``blocks`` deals the text that may repeat to shards, so that equal windows of ``length`` words
always meet in one shard.  A shard's text becomes an FM-index: suffixes ordered through the window
length, their preceding words (the BWT) in a wavelet matrix of packed bits with a rank directory.
The shard's documents are streamed against it: a backward search from every window's last word
gives its matching statistic, cut off at ``length``; windows whose suffix interval still holds two
or more suffixes repeat, and all but the earliest of an interval are reported.

Words are compared by 64-bit hashes.  Nulls and repeated rows: see ``texts.keyed``.  A null or
empty text has no words; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kestrel.llm import blocks as B, hashing as H, texts as T

LENGTH = 20
MINIMIZER = 6
STREAM = 400_000
KEPT_SCHEMA = "doc_id long, n_words long, n_removed long, kept binary"


class WaveletMatrix:
    """Rank over a sequence of symbols, one packed bit level per binary digit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.depth = len(seq), max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (seq >> level) & 1 == 1
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view("<u8")
            counts = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.bits.append(packed)
            self.ones.append(counts[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.depth):
            word = i >> 6
            below = self.bits[level][word] & ((H.U(1) << (i & 63).astype(np.uint64)) - H.U(1))
            rank = self.ones[level][word] + np.bitwise_count(below)
            one = (symbol >> (self.depth - 1 - level)) & 1 == 1
            i = np.where(one, self.zeros[level] + rank, i - rank)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        return self._descend(symbol, i) - self.first[symbol]


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least, by prefix doubling."""
    n, rank, h = len(seq), seq.astype(np.int64), 1
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:max(0, n - h)] = rank[h:]
        key = rank * (int(rank.max(initial=0)) + 1) + nxt
        order = np.argsort(key, kind="stable")
        h *= 2
        sorted_key = key[order]
        new = np.ones(n, dtype=np.int64)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        if h >= depth or new.all():
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)


class FMIndex:
    """Backward search over a sequence of symbols below ``sigma``; 0 separates texts."""

    def __init__(self, seq: np.ndarray, sigma: int, depth: int):
        order = suffix_order(seq, depth)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.bwt = WaveletMatrix(seq[order - 1], sigma)

    def widen(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of ``symbol + pattern`` from those of ``pattern``."""
        base = self.below[symbol]
        return base + self.bwt.rank(symbol, lo), base + self.bwt.rank(symbol, hi)


def matching(index: FMIndex, seq: np.ndarray, start: np.ndarray, length: int):
    """Of windows at ``start``, those that occur twice or more, with their suffix interval's start."""
    at = start + length - 1
    lo, hi = index.below[seq[at]], index.below[seq[at] + 1]
    live = np.arange(len(start))
    for _ in range(length):
        keep = hi - lo > 1
        live, at, lo, hi = live[keep], at[keep] - 1, lo[keep], hi[keep]
        if not len(live) or at[0] < start[live[0]]:
            break
        lo, hi = index.widen(seq[at], lo, hi)
    return live, lo


def settle(group: dict, spec: B.Spec):
    """Windows of one shard that equal an earlier window, by its FM-index."""
    starts, stops, off = H.words(group["data"], group["off"])
    hashes = H.word_hashes(group["data"], starts, stops)
    lens = np.diff(off)
    _, ids, count = np.unique(hashes, return_inverse=True, return_counts=True)
    # a word that the shard holds once ends every match: all such words share the symbol 1
    common = count > 1
    symbol = np.where(common, np.cumsum(common) + 1, 1)[ids]
    place = np.arange(len(symbol)) + np.repeat(np.arange(len(lens)), lens)
    seq = np.zeros(len(symbol) + len(lens) + 1, dtype=np.int64)
    seq[place] = symbol
    windows = group["windows"].astype(np.int64)
    row = np.repeat(np.arange(len(windows)), windows)
    first = T.expand(off[:-1] + np.arange(len(lens)), windows)
    ended = np.concatenate([[0], np.cumsum(seq <= 1)])
    may = ended[first + spec.length] == ended[first]
    if not may.any():
        return B.runs(row[:0], first[:0])
    row, first = row[may], first[may]
    index = FMIndex(seq, int(common.sum()) + 2, spec.length)
    got, interval = [], []
    for at in range(0, len(first), STREAM):
        live, lo = matching(index, seq, first[at:at + STREAM], spec.length)
        got.append(live + at)
        interval.append(lo)
    got, interval = np.concatenate(got), np.concatenate(interval)
    later = np.ones(len(got), dtype=bool)
    later[np.unique(interval, return_index=True)[1]] = False
    got = got[later]
    return B.runs(row[got], first[got] - (off[:-1] + np.arange(len(lens)))[row[got]])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Word ranges of ``texts.keyed`` documents covered by a window that also starts earlier."""
    return B.repeats(docs, B.Spec(length, min(MINIMIZER, max(1, length // 3)), by_words=True), settle)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's words outside repeated runs, joined by one space; a row per input row."""
    keyed = T.keyed(docs, id_col, text_col)
    spans = B.spans_by_doc(repeated_spans(keyed, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            loff, f = T.list_of_structs(batch.column("spans"))
            for lo, hi in T.pieces(off):
                part = data[off[lo]:off[hi]]
                starts, stops, at = H.words(part, off[lo:hi + 1] - off[lo])
                pick = slice(loff[lo], loff[hi])
                base = np.repeat(at[:-1], np.diff(loff[lo:hi + 1]))
                gone = B.merged(len(starts), f["start"][pick] + base, f["stop"][pick] + base)
                count = np.concatenate([[0], np.cumsum(gone)])
                starts, lens = starts[~gone], (stops - starts)[~gone]
                to = np.concatenate([[0], np.cumsum(lens + 1)])
                kept = np.full(int(to[-1]), 32, dtype=np.uint8)
                kept[T.expand(to[:-1], lens)] = part[T.expand(starts, lens)]
                koff = to[at - count[at]]
                some = (koff[1:] > koff[:-1]).astype(np.int64)  # without the space after the last word
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(np.diff(count[at])),
                     T.string_array(kept, koff[:-1], koff[1:] - some)], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = keyed.join(spans, ["doc_id", "copy"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, KEPT_SCHEMA).withColumn("doc_id", T.public_id())
