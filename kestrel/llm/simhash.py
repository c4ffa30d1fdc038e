"""SimHash near-dedup: a byte-position inverted index over fingerprints with count filtering.

A fingerprint is eight positional bytes.  Two fingerprints within ``MAX_BITS`` = 3 differing bits
share at least 8 - 3 = 5 of them.  The inverted index posts a fingerprint not under single bytes
(2,048 lists, each a fixed share of the corpus) but under 14 sets of four positions, a Steiner
quadruple system: every five positions contain one of the sets, so a pair that reaches the minimum
meets in some list, and lists shrink by 2**32.  Inside a list the shared positional bytes of a pair
are tallied, pairs below five matches go, the rest is verified by bit count.  Lists give a
spanning star per group, never all pairs.  Only distinct fingerprints enter the index.

A null or empty text has fingerprint zero and is linked like any other.  A null id never becomes
a component id unless a component has no other.  Repeated rows each get their own row, with the same
fingerprint and component.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kestrel.llm import components, hashing as H, texts as T
from kestrel.session import cut_lineage

SHINGLE = 3
SEED = 42
MAX_BITS = 3
PAIRINGS = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
#: Four positions each; any five of the eight positions contain one of these sets.
POSITIONS = [(0, 1, 2, 3), (4, 5, 6, 7), *((*a, b[0] + 4, b[1] + 4) for pairing in PAIRINGS for a in pairing for b in pairing)]
#: A longer list is searched by flipping bits, which is linear in its length.
PAIRWISE = 8192


def normalized(data: np.ndarray, off: np.ndarray):
    """Texts in lower case (A-Z) with one space between words: bytes, word starts, word stops, word offsets."""
    data = H.LOWER[data]
    starts, stops, at = H.words(data, off)
    lens = stops - starts
    to = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(int(to[-1]), 32, dtype=np.uint8)
    out[T.expand(to[:-1], lens)] = data[T.expand(starts, lens)]
    return out, to[:-1], to[:-1] + lens, at


def shingle_hashes(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word shingle, and the shingle offset of each text."""
    norm, starts, stops, at = normalized(data, off)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = T.expand(at[:-1], count)
    last = first + np.repeat(np.minimum(size, n) - 1, count)
    raw, digest = norm.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts[first].tolist(), stops[last].tolist())), dtype=np.uint64, count=len(first))
    return h, np.concatenate([[0], np.cumsum(count)])


def majority(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bits set in over half the hashes of each text, as one signed long."""
    n = np.diff(off)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, off[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, keys: list[str], shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """``keys`` and the fingerprint ``fp`` of every row."""
    rows = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8(batch.column("_text"))
            for lo, hi in T.pieces(off, T.CHUNK // 2):
                fp = majority(*shingle_hashes(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], shingle))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in keys), pa.array(fp)], names=[*keys, "fp"])

    return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in keys), StructField("fp", LongType())]))


def _posting_keys(fp: Column) -> Column:
    """The list keys of a fingerprint: set number and its four bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for number, positions in enumerate(POSITIONS):
        key = F.lit(number).cast("long")
        for i in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte[i])
        keys.append(key)
    return F.array(*keys)


def matches(x: np.ndarray) -> np.ndarray:
    """Positional bytes shared by two fingerprints with exclusive-or ``x``."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)


def linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification."""
    x = a ^ b
    ok = matches(x) >= 8 - max_bits
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


def list_pairs(fp: np.ndarray, positions: tuple[int, ...], max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (places) of one long posting list of distinct sorted fingerprints."""
    n = len(fp)
    if n <= PAIRWISE:
        step = max(1, 2_000_000 // n)
        for lo in range(0, n, step):
            i, j = np.nonzero(np.bitwise_count(fp[lo:lo + step, None] ^ fp[None, :]) <= max_bits)
            up = j > i + lo
            i, j = i[up] + lo, j[up]
            ok = linked(fp[i], fp[j], max_bits)
            yield i[ok], j[ok]
        return
    free = [H.U(1) << H.U(8 * p + b) for p in range(8) if p not in positions for b in range(8)]
    for size in range(1, max_bits + 1):
        for flips in combinations(free, size):
            other = fp ^ np.bitwise_or.reduce(np.array(flips))
            j = np.minimum(np.searchsorted(fp, other), n - 1)
            i = np.flatnonzero((fp[j] == other) & (fp < other))
            yield i, j[i]


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and least node of its component, for the linked pairs a, b of one task."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _search(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the linked fingerprints of whole posting lists, ordered by (key, fp)."""
    head = np.ones(len(key), dtype=bool)
    head[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(key)))
    got: list[tuple[np.ndarray, np.ndarray]] = []
    short = size <= 64
    of = np.repeat(np.arange(len(begin)), size)
    rows = np.flatnonzero(short[of])
    rest = (begin + size)[of] - np.arange(len(key))  # members from here to the list's end
    for d in range(1, int(size[short].max(initial=1))):
        rows = rows[rest[rows] > d]
        ok = linked(fp[rows], fp[rows + d], max_bits)
        got.append((fp[rows[ok]], fp[rows[ok] + d]))
    for k in np.flatnonzero(~short):
        own = fp[begin[k]:begin[k] + size[k]]
        for i, j in list_pairs(own, POSITIONS[int(key[begin[k]]) >> 32], max_bits):
            got.append(star(own[i], own[j]))
    if not got:
        return fp[:0], fp[:0]
    return star(*(np.concatenate(c) for c in zip(*got)))


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` within ``max_bits`` bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the position sets guarantee a shared list up to 3 bits only")
    posted = prints.select(F.explode(_posting_keys(F.col("fp"))).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            a, b = _search(k, f, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            # unsigned order, as the long lists are searched in it
            fp = np.concatenate([fp, batch.column("unsigned").to_numpy().view(np.uint64) ^ (H.U(1) << H.U(63))])
            cut = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
            if cut >= 200_000:
                yield out(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield out(key, fp)

    top = F.lit(-(1 << 63))
    return (posted.withColumn("unsigned", F.col("fp").bitwiseXOR(top)).select("key", "unsigned").repartition("key")
            .sortWithinPartitions("key", "unsigned").mapInArrow(run, "a long, b long"))


def roots(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints``, one row per fingerprint ``fp``, with the ``root`` of its component."""
    root = components.roots(links(prints.select("fp"), max_bits))
    return prints.join(root, prints.fp == root.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id: the least id reachable over links."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = cut_lineage(fingerprints(rows, ["doc_id"], shingle))
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = roots(prints, max_bits)
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(component, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every component the document that ``texts.with_keys`` orders first, with all its columns."""
    keyed = T.carried(docs, id_col, text_col)
    marked = cut_lineage(fingerprints(keyed, ["_id", "_copy"], shingle, "_text"))
    prints = cut_lineage(marked.groupBy("fp").agg(F.min(F.struct("_id", "_copy")).alias("first")))
    kept = roots(prints, max_bits).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return keyed.where("_listing = 1").join(kept, ["_id", "_copy"], "left_semi").select(*T.restored(docs).values())
