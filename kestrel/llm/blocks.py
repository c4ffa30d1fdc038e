"""Which windows of a fixed length repeat anywhere in a corpus, without a row per window.

Every window of ``length`` symbols (bytes or words) is addressed by its minimizer: the run of
``k`` symbols inside it with the least hash.  Equal windows have equal minimizers at equal
offsets, so that run is the window's most significant digit.  Neighbouring windows with the same
minimizer form a *block*, about ``(length - k) / 2`` windows, and only blocks are shuffled:

1. ``blocks`` finds them in the scan.  A block already seen in the same Arrow batch is decided
   there, so a copy that fills a third of the corpus reaches the shuffle once per batch.
2. ``classify`` sorts blocks by (digit, content hash, position).  A block equal to an earlier one
   repeats throughout; a block alone under its digit is unique; what is left, the first of each
   of several different blocks under one digit, is partly repeated at most: a *candidate*.
3. ``split_candidates`` fetches the text of candidates only and deals it by a second digit of
   about two thirds of the window, taken on that side of the minimizer that the window reaches.

The operators order or search those candidates exactly, each by its own method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kestrel.llm import hashing as H, texts as T
from kestrel.session import cut_lineage

BLOCK_SCHEMA = "key long, content long, doc_id long, copy int, start long, shape int, stop long"
PART_SCHEMA = "key long, doc_id long, copy int, start long, windows int, body binary"
ORDER_BITS = H.U(24)


@dataclass(frozen=True)
class Spec:
    length: int
    k: int
    by_words: bool = False

    @property
    def side(self) -> int:
        """From this distance between a window's start and its minimizer, the left digit is used."""
        return (self.length - self.k + 1) // 2


def symbols(data: np.ndarray, offsets: np.ndarray, spec: Spec):
    """Symbol hashes, the symbol offset of each text, and each symbol's byte start and stop."""
    if not spec.by_words:
        at = np.arange(len(data) + 1, dtype=np.int64)
        return H.BYTES[data], offsets, at[:-1], at[1:]
    starts, stops, off = H.words(data, offsets)
    return H.word_hashes(data, starts, stops), off, starts, stops


def _minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least (hash, position) of every ``w`` neighbours."""
    n = len(h)
    low = (H.U(1) << ORDER_BITS) - H.U(1)
    m = (h & ~low) | np.arange(n, dtype=np.uint64)
    out, done = m, 1
    while done * 2 <= w:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < w:
        out = np.minimum(out[:n - w + 1], out[w - done:w - done + n - w + 1])
    return (out & low).astype(np.int64)


def find(x: np.ndarray, offsets: np.ndarray, spec: Spec):
    """Blocks of concatenated texts: text number, first window, last window, minimizer, digit, content."""
    none = np.zeros(0, np.int64)
    n, length = len(x), spec.length
    if n < length:
        return none, none, none, none, none, none
    if n >= 1 << int(ORDER_BITS):
        return _find_long(x, offsets, spec)
    p = H.prefix(x)
    h = H.fixed(p, spec.k) if n > spec.k else H.ranges(p, np.array([0]), np.array([n]))
    a = _minimizers(_with_last(h, p, spec.k), length - spec.k + 1)
    lens = np.diff(offsets)
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    ok = np.cumsum(edge[:-1])[:len(a)] == 0
    del edge
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (a[1:] != a[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (a[1:] != a[:-1])
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    at = a[s]
    text = np.searchsorted(offsets, s, side="right") - 1
    assert lens[text].min(initial=length) >= length
    return text, s, e, at, H.ranges(p, at, at + spec.k), H.ranges(p, s, e + length)


def _with_last(h: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """``fixed`` leaves out the run that ends with the last symbol; add it."""
    n = len(p) - 1
    return h if len(h) == n - k + 1 else np.append(h, H.ranges(p, np.array([n - k]), np.array([n])))


def _find_long(x, offsets, spec):
    """One text of many million symbols: overlapping stretches, whose seam blocks may be cut in two."""
    parts, size = [], (1 << int(ORDER_BITS)) - 1
    for i in range(len(offsets) - 1):
        lo, end = int(offsets[i]), int(offsets[i + 1])
        while end - lo >= spec.length:
            hi = min(end, lo + size)
            _, s, e, at, kh, bh = find(x[lo:hi], np.array([0, hi - lo]), spec)
            parts.append((np.full(len(s), i), s + lo, e + lo, at + lo, kh, bh))
            if hi == end:
                break
            lo = hi - spec.length + 1
    cols = zip(*parts) if parts else [[np.zeros(0, np.int64)]] * 6
    return tuple(np.concatenate(c) for c in cols)


def blocks(docs: DataFrame, spec: Spec) -> DataFrame:
    """A row per block, or per stretch of blocks that the batch itself shows to be repeats (``shape`` < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("doc_id", "ascending"), ("copy", "ascending")]).combine_chunks()
            if not table.num_rows:
                continue
            ids, copies = table["doc_id"].to_numpy(), table["copy"].to_numpy()
            data, off = T.utf8(table["text"].chunk(0))
            got = []
            for lo, hi in T.pieces(off):
                x, sym, _, _ = symbols(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], spec)
                text, s, e, at, kh, bh = find(x, sym, spec)
                base = sym[text] if len(text) else text
                got.append((text + lo, s - base, e - base, at - s, kh, bh))
            text, s, e, at, kh, bh = (np.concatenate(c) for c in zip(*got))
            if not len(s):
                continue
            seen = np.ones(len(s), dtype=bool)
            seen[np.unique(bh, return_index=True)[1]] = False
            keep = ~seen
            rows = [(kh[keep].view(np.int64), bh[keep].view(np.int64), ids[text[keep]], copies[text[keep]], s[keep],
                     ((e - s)[keep] << 16 | at[keep]).astype(np.int32), e[keep] + spec.length)]
            if seen.any():
                t, a, b = text[seen], s[seen], e[seen]
                head = np.ones(len(t), dtype=bool)
                head[1:] = (t[1:] != t[:-1]) | (a[1:] != b[:-1] + 1)
                tail = np.append(head[1:], True)
                t, a, b = t[head], a[head], b[tail]
                rows.append((H.mix(ids[t].view(np.uint64) + a.view(np.uint64)).view(np.int64), np.zeros(len(t), np.int64), ids[t], copies[t],
                             a, np.full(len(t), -1, np.int32), b + spec.length))
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in r], names=["key", "content", "doc_id", "copy", "start", "shape", "stop"])

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def classify(found: DataFrame) -> DataFrame:
    """Repeats (``shape`` null: all of [start, stop) repeats) and candidates; unique blocks go."""
    content = F.when(F.col("shape") >= 0, F.col("content"))
    w = Window.partitionBy("key").orderBy("content", "doc_id", "copy", "start")
    every = Window.partitionBy("key").orderBy("content", "doc_id", "copy", "start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = (found.withColumn("content", content)
              .withColumn("before", F.lag("content").over(w))
              .withColumn("least", F.min("content").over(every))
              .withColumn("most", F.max("content").over(every)))
    again = (F.col("shape") < 0) | (F.col("before").isNotNull() & (F.col("before") == F.col("content")))
    return (marked.where(again | (F.col("least") < F.col("most")))
            .select("doc_id", "copy", "start", "stop", F.when(~again, F.col("shape")).alias("shape"), F.when(~again, F.col("key")).alias("key")))


def split_candidates(docs: DataFrame, candidates: DataFrame, spec: Spec) -> DataFrame:
    """The text of candidate blocks, dealt by the second digit (``key``)."""
    per_doc = candidates.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "shape", "key")).alias("blocks"))
    side, length, k = spec.side, spec.length, spec.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            ids, copies = batch.column("doc_id").to_numpy(), batch.column("copy").to_numpy()
            loff, f = T.list_of_structs(batch.column("blocks"))
            for lo, hi in T.pieces(off):
                x, sym, bs, be = symbols(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], spec)
                p = H.prefix(x)
                pick = slice(loff[lo], loff[hi])
                text = np.repeat(np.arange(lo, hi), np.diff(loff[lo:hi + 1]))
                start, shape = f["start"][pick], f["shape"][pick]
                s = start + sym[text - lo]
                e, a = s + (shape >> 16), s + (shape & 0xFFFF)
                salt = f["key"][pick].view(np.uint64)
                left = (np.minimum(e, a - side), s, H.U(1), a - side, a + k)
                right = (e, np.maximum(s, a - side + 1), H.U(2), a, a + length - side + 1)
                for hi_w, lo_w, tag, h0, h1 in (left, right):
                    ok = lo_w <= hi_w
                    key = H.mix(H.ranges(p, h0[ok], h1[ok]) ^ (salt[ok] + tag))
                    b0, b1 = bs[lo_w[ok]], be[hi_w[ok] + length - 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(ids[text[ok]]), pa.array(copies[text[ok]]),
                         pa.array(start[ok] + lo_w[ok] - s[ok]), pa.array((hi_w - lo_w)[ok].astype(np.int32) + 1),
                         T.string_array(data[off[lo]:off[hi]], b0, b1)],
                        names=["key", "doc_id", "copy", "start", "windows", "body"])

    return docs.join(per_doc, ["doc_id", "copy"]).select("doc_id", "copy", "text", "blocks").mapInArrow(run, PART_SCHEMA)


def repeats(docs: DataFrame, spec: Spec, settle: Callable[[Iterator[dict], Spec], Iterator[tuple]]) -> DataFrame:
    """(doc_id, copy, start, stop): symbol ranges covered by windows that also start earlier.

    ``docs``: documents as ``texts.keyed`` gives them.
    ``settle`` gets, per shard, the candidate parts ordered by (key, position) and yields
    (row, first, last) window runs that repeat an earlier window of the shard.
    """
    docs = T.distinct(docs)
    done = cut_lineage(classify(blocks(docs, spec)))
    parts = split_candidates(docs, done.where("shape is not null"), spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches):
            row, first, last = settle(group, spec)
            start = group["start"][row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group["doc_id"][row]), pa.array(group["copy"][row]), pa.array(start + first), pa.array(start + last + spec.length)],
                names=["doc_id", "copy", "start", "stop"])

    edge = (parts.repartition("key").sortWithinPartitions("key", "doc_id", "copy", "start")
            .mapInArrow(run, "doc_id long, copy int, start long, stop long"))
    return done.where("shape is null").select("doc_id", "copy", "start", "stop").unionByName(edge)


#: Windows settled at a time; keys are never cut.
SETTLE = 1_500_000


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows under keys that hold two or more, in runs of whole keys."""
    held: list[pa.Table] = []
    count = 0

    def out(table: pa.Table) -> Iterator[dict]:
        table = table.combine_chunks()
        key = table["key"].to_numpy()
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        single = new & np.append(new[1:], True)
        if single.all():
            return
        rows = np.flatnonzero(~single)
        table = table.take(pa.array(rows)).combine_chunks()
        data, off = T.utf8(table["body"].chunk(0))
        yield {"group": np.cumsum(new[rows]) - 1, "data": data, "off": off,
               **{c: table[c].to_numpy() for c in ("doc_id", "copy", "start", "windows")}}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += int(batch.column("windows").to_numpy().sum())
        if count >= SETTLE:
            table = pa.concat_tables(held)
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield from out(table.slice(0, cut))
                held = [table.slice(cut)]
                count = int(held[0]["windows"].to_numpy().sum())
    if held:
        yield from out(pa.concat_tables(held))


def runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows (sorted by row, then place) as (row, first, last)."""
    if not len(row):
        return row, at, at
    head = np.ones(len(row), dtype=bool)
    head[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    tail = np.append(head[1:], True)
    return row[head], at[head], at[tail]


def spans_by_doc(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Mask of covered symbols."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge[:-1]) > 0
