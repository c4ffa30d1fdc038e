"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of what they join.

1. The test items' word n-grams are counted over all documents; each item keeps as seeds those that
   the corpus has at most ``RARITY`` times as often as the item's median n-gram (or ``RARE`` times at
   all).  Rarity is relative to the item, so an item that leaked into many documents keeps its seeds,
   also those that only an edited copy shares with it.
2. A scan of the documents finds seeds and cuts a passage around them, as far as the seed's item
   could reach with ``MARGIN`` more words on each side; passages that touch are one.
3. Passages join items on seeds; every pair is aligned word by word (local alignment, linear
   gaps).  The score is the alignment's share of the item's perfect score; from ``THRESHOLD`` on the
   document holds a copy, an edited one too.

Words are runs of letters, digits and non-ASCII bytes in lower case (A-Z).  Benchmarks are small next
to the corpus but of no fixed size: tasks get at most ``SEEDS`` n-grams at a time, a larger
benchmark takes several scans.  An item of fewer than ``SEED`` words has no seed and is never found.  Null
and empty texts hold nothing; a null item id is an item like any other.  Rows listed twice count twice
towards rarity and are reported once; ids: ``texts.keyed``.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from kestrel.llm import hashing as H, texts as T
from kestrel.llm.tally import Tally
from kestrel.session import cut_lineage

SEED = 3
RARITY, RARE = 4.0, 16
MARGIN = 6
MATCH, MISMATCH, GAP = 2, 1, 1
THRESHOLD = 0.4
SEEDS = 1_000_000
#: Cells of one alignment batch.
CELLS = 4_000_000

_PLAIN = np.full(256, 32, dtype=np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _PLAIN[_b] = _b
_PLAIN[65:91] = np.arange(97, 123)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of concatenated texts and the word offset of each text."""
    data = _PLAIN[data]
    starts, stops, at = H.words(data, off)
    return H.word_hashes(data, starts, stops), at


def ngrams(x: np.ndarray, at: np.ndarray, n: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every n-gram that lies within one text."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(owner[:len(x) - n + 1] == owner[n - 1:]) if len(x) >= n else np.zeros(0, np.int64)
    return first, H.ranges(H.prefix(x), first, first + n)


class Lookup:
    """Places of values in a sorted array; a bit table turns most other values away."""

    def __init__(self, values: np.ndarray):
        self.values, self.bits = values, np.zeros(1 << 22, bool)
        self.bits[(values >> H.U(42)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``x`` are there, and where."""
        may = np.flatnonzero(self.bits[(x >> H.U(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, x[may]), len(self.values) - 1)
        ok = self.values[at] == x[may]
        return may[ok], at[ok]


def item_grams(items: DataFrame) -> DataFrame:
    """(item, gram, place, size): every n-gram of every item, with the item's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = words(*T.utf8(batch.column("text")))
            first, gram = ngrams(x, at)
            owner = np.searchsorted(at, first, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(owner)), pa.array(gram.view(np.int64)), pa.array((first - at[owner]).astype(np.int32)),
                 pa.array(np.diff(at)[owner].astype(np.int32))], names=["item", "gram", "place", "size"])

    return items.select("item", "text").mapInArrow(run, "item long, gram long, place int, size int")


def _blocks(values: DataFrame, columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a table that tasks must hold, at most about SEEDS at a time, ordered by gram."""
    n = max(1, -(-values.count() // SEEDS))
    for k in range(n):
        part = values.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == k).select(*columns).toPandas().sort_values("gram")
        if len(part):
            yield {c: part[c].to_numpy() for c in columns}


def gram_counts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, n): how often the documents hold each n-gram of the items; none for those without."""
    spark, found = docs.sparkSession, []
    for block in _blocks(grams.select("gram").distinct(), ["gram"]):
        shared = spark.sparkContext.broadcast(np.sort(block["gram"].astype(np.int64).view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, tally = Lookup(shared.value), Tally()
            for batch in batches:
                data, off = T.utf8(batch.column("text"))
                for lo, hi in T.pieces(off):
                    _, gram = ngrams(*words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]))
                    _, at = known(gram)
                    tally.add(known.values[at])
            yield from tally.take()

        found.append(docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "gram long, n long")


def seeds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item, gram, place, size) of the n-grams of each item that are rare for it and that the documents hold."""
    grams = cut_lineage(item_grams(items))
    counted = grams.join(gram_counts(docs, grams), "gram")
    usual = counted.groupBy("item").agg(F.median("n").alias("usual"))
    rare = counted.join(usual, "item").where((F.col("n") <= RARE) | (F.col("n") <= RARITY * F.col("usual")))
    return cut_lineage(rare.select("item", "gram", "place", "size"))


PASSAGE = "doc_id long, copy int, start long, words array<long>, grams array<long>"


def passages(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Passages of the documents around seeds: their words' hashes and the seeds they hold.

    ``docs`` has every document once.
    """
    spark, found = docs.sparkSession, []
    reach = chosen.groupBy("gram").agg(F.max("place").alias("before"), F.max(F.col("size") - F.col("place")).alias("after"))
    for block in _blocks(reach, ["gram", "before", "after"]):
        order = np.argsort(block["gram"].astype(np.int64).view(np.uint64))
        shared = spark.sparkContext.broadcast({"gram": block["gram"].astype(np.int64).view(np.uint64)[order],
                                               "before": block["before"][order].astype(np.int64), "after": block["after"][order].astype(np.int64)})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            known = Lookup(held["gram"])
            for batch in batches:
                data, off = T.utf8(batch.column("text"))
                ids, copies = batch.column("doc_id").to_numpy(), batch.column("copy").to_numpy()
                for lo, hi in T.pieces(off):
                    x, at = words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                    first, gram = ngrams(x, at)
                    hit, place = known(gram)
                    if not len(hit):
                        continue
                    pos = first[hit]
                    doc = np.searchsorted(at, pos, side="right") - 1
                    begin = np.maximum(at[doc], pos - held["before"][place] - MARGIN)
                    end = np.minimum(at[doc + 1], pos + held["after"][place] + MARGIN)
                    by = np.lexsort((begin, doc))
                    begin, end, doc, place = begin[by], end[by], doc[by], place[by]
                    # texts lie one after another, so ends only grow from text to text
                    far = np.maximum.accumulate(end)
                    new = np.ones(len(by), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] >= far[:-1])
                    head = np.flatnonzero(new)
                    b, e = begin[head], np.maximum.reduceat(end, head)
                    bounds = np.append(head, len(by))
                    lists = [np.unique(held["gram"][place[bounds[k]:bounds[k + 1]]]).view(np.int64) for k in range(len(head))]
                    texts = [x[b[k]:e[k]].view(np.int64) for k in range(len(head))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo + doc[head]]), pa.array(copies[lo + doc[head]]), pa.array(b - at[doc[head]]),
                         pa.array(texts, pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "copy", "start", "words", "grams"])

        found.append(docs.select("doc_id", "copy", "text").mapInArrow(run, PASSAGE))
    if not found:
        return spark.createDataFrame([], PASSAGE)
    return found[0] if len(found) == 1 else _merged(reduce(DataFrame.unionByName, found))


def _merged(cut: DataFrame) -> DataFrame:
    """Passages of several scans, those that overlap as one, as a single scan would have cut them."""
    before = Window.partitionBy("doc_id", "copy").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("start") >= F.max(F.col("start") + F.size("words")).over(before)
    island = F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(Window.partitionBy("doc_id", "copy").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    met = (cut.withColumn("_island", island).groupBy("doc_id", "copy", "_island")
           .agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "words", "grams"))).alias("_parts")))

    def stitched(have, part):
        known = F.col("start") + F.size(have) - part["start"]  # words of the part that are there already
        return F.concat(have, F.slice(part["words"], (known + 1).cast("int"), F.greatest(F.lit(0), (F.size(part["words"]) - known).cast("int"))))

    words = F.aggregate(F.slice("_parts", 2, F.size("_parts")), F.col("_parts")[0]["words"], stitched)
    return met.select("doc_id", "copy", "start", words.alias("words"), F.array_distinct(F.flatten("_parts.grams")).alias("grams"))


def align(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Best local alignment score of each pair of rows; 0 pads items, 1 pads texts."""
    n, width = texts.shape
    ramp = GAP * np.arange(width + 1)
    row, best = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32)
    for i in range(items.shape[1]):
        fit = np.where(texts == items[:, i, None], MATCH, -MISMATCH)
        cell = np.zeros((n, width + 1), np.int32)
        cell[:, 1:] = np.maximum(np.maximum(row[:, :-1] + fit, row[:, 1:] - GAP), 0)
        # gaps in the text: the best cell to the left, less a gap for every step
        row = np.maximum.accumulate(cell + ramp, axis=1) - ramp
        best = np.maximum(best, row.max(axis=1))
    return best


def _padded(lists: list[np.ndarray], pad: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), pad, np.int64)
    for k, x in enumerate(lists):
        out[k, :len(x)] = x
    return out


def aligned(pairs: DataFrame) -> DataFrame:
    """``pairs`` (item_words, words: array<long>) with ``score``: the share of the item's perfect score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, text = ([np.asarray(v, np.int64) for v in batch.column(c).to_pylist()] for c in ("item_words", "words"))
            score = np.zeros(len(item))
            order = sorted(range(len(item)), key=lambda k: len(text[k]))
            lo = 0
            while lo < len(order):
                hi = lo + 1
                while hi < len(order) and (hi + 1 - lo) * (len(text[order[hi]]) + 1) * 4 <= CELLS:
                    hi += 1
                pick = order[lo:hi]
                best = align(_padded([item[k] for k in pick], 0), _padded([text[k] for k in pick], 1))
                score[pick] = best / np.array([MATCH * max(1, len(item[k])) for k in pick])
                lo = hi
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "copy", "start", "item")), pa.array(score)],
                                             names=["doc_id", "copy", "start", "item", "score"])

    return (pairs.select("doc_id", "copy", "start", "item", "item_words", "words")
            .mapInArrow(run, "doc_id long, copy int, start long, item long, score double"))


def item_words(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = words(*T.utf8(batch.column("text")))
            lists = [x[at[k]:at[k + 1]].view(np.int64) for k in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(lists, pa.list_(pa.int64()))], names=["item", "item_words"])

    return items.select("item", "text").mapInArrow(run, "item long, item_words array<long>")


def _leaks(keyed: DataFrame, items: DataFrame, threshold: float, item_col: str, text_col: str) -> DataFrame:
    """(doc_id, copy, item_id, score, start) of documents, by key, and the items they hold."""
    own = T.with_keys(items.select(item_col, text_col), item_col, text_col).where("_listing = 1")
    own = cut_lineage(own.select(F.monotonically_increasing_id().alias("item"), F.col("_id").alias("item_id"),
                                 F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    chosen = seeds(keyed, own)
    cut = cut_lineage(passages(T.distinct(keyed), chosen))
    place = ["doc_id", "copy", "start"]
    met = (cut.select(*place, F.explode("grams").alias("gram")).join(chosen.select("gram", "item").distinct(), "gram")
           .select(*place, "item").distinct())
    pairs = met.join(cut.select(*place, "words"), place).join(item_words(own), "item")
    scored = aligned(pairs).where(F.col("score") >= threshold)
    best = scored.groupBy("doc_id", "copy", "item").agg(F.max(F.struct("score", (-F.col("start")).alias("before"))).alias("best"))
    return (best.join(own.select("item", "item_id"), "item")
            .select("doc_id", "copy", T.public_id("item_id"), F.col("best.score").alias("score"), (-F.col("best.before")).alias("start")))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start): a row per document and item it holds a copy of; start: the passage's first word."""
    found = _leaks(T.keyed(docs, id_col, text_col), items, threshold, item_col, item_text_col)
    return found.select(T.public_id(), "item_id", "score", "start")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no copy of an item, with all their columns."""
    keys = T.carried(docs, id_col, text_col)
    keyed = keys.select(F.col("_id").alias("doc_id"), F.col("_copy").alias("copy"), F.col("_listing").alias("listing"),
                        F.coalesce(F.col("_text"), F.lit("")).alias("text"))
    found = cut_lineage(_leaks(keyed, items, threshold, item_col, item_text_col).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).distinct())
    return keys.join(found, ["_id", "_copy"], "left_anti").select(*T.restored(docs).values())
