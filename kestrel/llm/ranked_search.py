"""Ranked lexical search: the best documents of every item, by Block-Max MaxScore over sharded inverted lists.

**Index.**  A task cuts its documents into shards of bounded size.  A term's list in a shard is cut into
blocks of ``BLOCK`` postings, a row each: first and last document, byte-packed gaps and frequencies, and the frontier of
its (frequency, document length) pairs that no other pair of the block beats.  A score rises with the frequency
and falls with the length, so the frontier gives the block's exact maximum under whatever corpus statistics hold
later; shards may be added without touching old ones.  One more row per shard, of the empty term, holds its documents.

**Search.**  Document counts of the items' terms, and the number and total length of documents, are summed from the index.  Items are
taken in blocks of bounded size; each block reads the lists of its terms, brought together by shard.  In a shard, an item's lists
stand by falling bound.  Lists are read whole while an unseen document could still reach the threshold, the lowest score that
the item has kept in this task; these are the essential lists.  The others only complete candidates: a candidate whose
score, block maximum and bounds of the lists to come stay below the threshold is rejected before its block is unpacked.  Every task keeps the best of its
shards, and these heaps are merged at the end.  Documents are only left out when their bound is below the threshold, so the result is exact.

Null or empty texts have no terms; such items get no rows.  A null document or item id stays null and orders first.  Rows that repeat are
documents, or items, of their own.  Other columns are left out, so no name can clash.  Long texts are read whole; a document longer than a shard's
limit is a shard by itself.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from kestrel.llm import texts as T
from kestrel.session import cut_lineage, spread

TOP = 50
BLOCK = 128
#: A shard is full at so many documents or bytes of text.
SHARD_DOCS = 16_384
SHARD_BYTES = 1 << 24
#: Distinct (item, term) pairs of a block of items.
PAIRS = 500_000
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
INDEX_SCHEMA = "shard long, term string, first int, last int, count int, total long, width int, best_tf array<int>, best_n array<int>, body binary"
FOUND_SCHEMA = "item long, item_id long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode().translate(LOWER)) if text else []


def frontier(group: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of the pairs that no other of their group beats: a higher tf needs a greater n to go with it."""
    order = np.lexsort((n, -tf, group))
    g, v = group[order], n[order].astype(np.int64)
    fallen = np.minimum.accumulate(v - (g - g[0] if len(g) else g) * (1 << 40)) if len(g) else v
    low = fallen + (g - g[0] if len(g) else g) * (1 << 40)
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (v[1:] < low[:-1])
    return order[keep]


def packed(gap: np.ndarray, tf: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The bytes an integer takes in each block, and the blocks: all gaps, then all frequencies."""
    widest = np.maximum.reduceat(np.maximum(gap, tf), start)
    width = np.where(widest < 1 << 8, 1, np.where(widest < 1 << 16, 2, 4))
    off = np.concatenate([[0], np.cumsum(2 * width * count)])
    out = np.zeros(off[-1], np.uint8)
    block = np.repeat(np.arange(len(start)), count)
    k = np.arange(len(gap)) - start[block]
    w = width[block]
    at_gap = off[block] + k * w
    at_tf = at_gap + (count * width)[block]
    for byte in range(4):
        on = w > byte
        out[at_gap[on] + byte] = (gap[on] >> (8 * byte)) & 255
        out[at_tf[on] + byte] = (tf[on] >> (8 * byte)) & 255
    body = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out)])
    return width, body.cast(pa.binary())


def unpacked(first: int, count: int, width: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(body, f"<u{width}").astype(np.int64)
    return first + np.cumsum(both[:count]), both[count:]


def lists(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, pa.int32()))


def shard_rows(shard: int, ids: list[int], found: list[list[bytes]], block: int) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard."""
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("count", pa.int32()), ("total", pa.int64()),
                        ("width", pa.int32()), ("best_tf", pa.list_(pa.int32())), ("best_n", pa.list_(pa.int32())), ("body", pa.binary())])
    n = np.array([len(f) for f in found], np.int64)
    body = np.array(ids, "<i8").tobytes() + n.astype("<i8").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, "", 0, len(ids) - 1, int((n > 0).sum()), int(n.sum()), 8, [], [], body), schema.types)], schema=schema)
    if not n.sum():
        return
    number: dict[bytes, int] = {}
    term = np.fromiter((number.setdefault(t, len(number)) for f in found for t in f), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(ids)), n)
    pair, tf = np.unique(term * len(ids) + doc, return_counts=True)
    term, doc = pair // len(ids), pair % len(ids)
    head = np.searchsorted(term, np.arange(len(number)))
    place = np.arange(len(term)) - head[term]
    new = place % block == 0
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    count = np.diff(np.append(start, len(term)))
    gap = np.diff(doc, prepend=0)
    gap[start] = 0
    best = np.sort(frontier(group, tf, n[doc]))
    width, bodies = packed(gap, tf, start, count)
    words = pa.array([t.decode() for t in number], pa.string())
    size = len(start)
    sizes = np.bincount(group[best], minlength=size)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(size, shard)), words.take(pa.array(term[start])), pa.array(doc[start], pa.int32()), pa.array(doc[start + count - 1], pa.int32()),
        pa.array(count, pa.int32()), pa.array(np.zeros(size, np.int64)), pa.array(width, pa.int32()), lists(tf[best], sizes), lists(n[doc][best], sizes), bodies], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents, for ``search``; write it where it should last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, found, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = len(text) if text else 0
                if ids and (len(ids) >= shard_docs or size + more > shard_bytes):
                    yield from shard_rows(base + made, ids, found, block)
                    made, ids, found, size = made + 1, [], [], 0
                ids.append(i)
                found.append(terms(text))
                size += more
        if ids:
            yield from shard_rows(base + made, ids, found, block)

    return spread(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(T.NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, INDEX_SCHEMA)


class Shard:
    """The lists of a shard that one block of items asks for, unpacked on demand."""

    def __init__(self, rows: pa.Table, weight: dict[str, int], n_docs: int, n_terms: int):
        names = rows.column("term").to_pylist()
        bodies = rows.column("body").to_pylist()
        own = names.index("")
        both = np.frombuffer(bodies[own], "<i8")
        self.ids, self.n = both[:len(both) // 2], both[len(both) // 2:]
        self.factor = 20 * (50 + (50 * self.n * n_docs) // max(n_terms, 1))
        number = lambda c: rows.column(c).to_numpy()
        self.first, self.last, self.count, self.width = (number(c).astype(np.int64) for c in ("first", "last", "count", "width"))
        self.body, self.open = bodies, {}
        tf, n = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("best_tf", "best_n"))
        lens = rows.column("best_tf").combine_chunks().value_lengths().to_numpy()
        w = np.array([weight.get(t, 0) for t in names], np.int64)
        at = np.cumsum(lens) - lens
        self.bound = np.zeros(len(names), np.int64)
        on = lens > 0
        if on.any():
            value = (10 ** 9 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))
            self.bound[on] = np.maximum.reduceat(value, at[on]) * w[on]
        self.w = w
        self.rows: dict[str, np.ndarray] = {}
        for k, t in enumerate(names):
            self.rows.setdefault(t, []).append(k)
        self.rows = {t: np.array(k)[np.argsort(self.first[k])] for t, k in self.rows.items() if t}
        self.whole: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.unpacked = 0

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and score shares of one block."""
        if k not in self.open:
            docs, tf = unpacked(int(self.first[k]), int(self.count[k]), int(self.width[k]), self.body[k])
            self.open[k] = docs, self.w[k] * ((10 ** 9 * tf) // (1000 * tf + self.factor[docs]))
            self.unpacked += 1
        return self.open[k]

    def list_of(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.whole:
            parts = [self.block(int(k)) for k in self.rows[term]]
            self.whole[term] = tuple(np.concatenate(p) for p in zip(*parts))
        return self.whole[term]

    def best(self, words: list[str], top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that can be among an item's ``top``, given that a score below ``least`` cannot."""
        here = [(int(self.bound[self.rows[t]].max()), t) for t in words if t in self.rows]
        here = sorted((h for h in here if h[0] > 0), reverse=True)
        rest = np.append(np.cumsum([b for b, _ in here][::-1])[::-1], 0).astype(np.int64)
        if rest[0] < max(least, 1):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(len(self.ids), np.int64)
        k = 0
        while k < len(here) and rest[k] >= least:
            docs, share = self.list_of(here[k][1])
            score[docs] += share
            k += 1
            if k < len(here) and len(score) >= top and rest[k] < score.max():
                least = max(least, int(np.partition(score, len(score) - top)[len(score) - top]))
        docs = np.flatnonzero((score > 0) & (score + rest[k] >= least))
        have = score[docs]
        for j in range(k, len(here)):
            blocks = self.rows[here[j][1]]
            b = np.searchsorted(self.first[blocks], docs, side="right") - 1
            within = (b >= 0) & (self.last[blocks[b]] >= docs)
            reach = have + rest[j + 1] + np.where(within, self.bound[blocks[b]], 0)
            stay = reach >= least
            docs, have, b, within = docs[stay], have[stay], b[stay], within[stay]
            for x in np.unique(b[within]).tolist():
                mine = np.flatnonzero(within & (b == x))
                held, share = self.block(int(blocks[x]))
                at = np.minimum(np.searchsorted(held, docs[mine]), len(held) - 1)
                have[mine] += np.where(held[at] == docs[mine], share[at], 0)
            if len(have) >= top:
                least = max(least, int(np.partition(have, len(have) - top)[len(have) - top]))
            stay = have + rest[j + 1] >= least
            docs, have = docs[stay], have[stay]
        return docs, have


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by shard, as one table per shard."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        col = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(col)) + 1).tolist(), len(col)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and col[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = col[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term): the distinct terms of every row of ``items``; item numbers the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = sorted({t.decode() for t in terms(text)})
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(words), pa.int64()), pa.array([i] * len(words), pa.int64()), pa.array(words, pa.string())], ["item", "item_id", "term"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "item long, item_id long, term string")


def search(index: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item, equal scores by ascending id."""
    spark = index.sparkSession
    wanted = cut_lineage(item_terms(items, id_col, text_col))
    n_docs, n_terms = (x or 0 for x in index.where("term = ''").agg(F.sum("count"), F.sum("total")).first())
    blocks = max(1, math.ceil(wanted.count() / pairs))
    df = cut_lineage(index.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("count").alias("df")))
    out = None
    for k in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        words: dict[int, tuple[int | None, list[str]]] = {}
        weight: dict[str, int] = {}
        for r in mine.join(df, "term").select("item", "item_id", "term", "df").toLocalIterator():  # PAIRS rows by the cut above
            words.setdefault(r[0], (r[1], []))[1].append(r[2])
            weight[r[2]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r[3] + 1)))
        shared = spark.sparkContext.broadcast((words, weight))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, weight = shared.value
            heap: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for rows in shards_of(batches):
                shard = Shard(rows, weight, n_docs, n_terms)
                for item, (_, its) in words.items():
                    ids, scores = heap.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    docs, more = shard.best(its, top, int(scores[-1]) if len(scores) == top else 1)
                    if len(docs):
                        ids, scores = np.concatenate([ids, shard.ids[docs]]), np.concatenate([scores, more])
                        order = np.lexsort((ids, -scores))[:top]
                        heap[item] = ids[order], scores[order]
            for item, (ids, scores) in heap.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array([words[item][0]] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)],
                                                 ["item", "item_id", "doc_id", "score"])

        asked = mine.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))
        lists_of = index.join(asked, "term").select(*[c for c in index.columns])
        found = lists_of.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FOUND_SCHEMA)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select(F.col("item_id").alias(id_col), "rank", T.public_id(), "score"))
