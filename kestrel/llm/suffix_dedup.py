"""Suffix-array dedup: repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``length`` bytes, most significant digit first, and every pass
goes on with those that still share their bucket: after the last pass, equal groups are exactly
the repeated windows.  The first two digits are taken over the cluster (``blocks``: the window's
minimizer, then two thirds of its bytes), so that unique text leaves before it is shuffled and
copies leave as whole blocks; the remaining passes run inside one shard of suffixes, eight bytes a
pass.  Two windows count as equal when all bytes agree, for whole blocks when a 64-bit hash of
the block's bytes and its digit agree.

Nulls and repeated rows: see ``texts.keyed``.  A null or empty text, or one shorter than
``length``, keeps all its bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kestrel.llm import blocks as B, texts as T

LENGTH = 100
MINIMIZER = 32
KEPT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def radix_pass(cls: np.ndarray, digit: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders live suffixes by (bucket, digit); those alone in their new bucket leave."""
    order = np.lexsort((digit, cls))
    cls, digit, live = cls[order], digit[order], live[order]
    new = np.ones(len(cls), dtype=bool)
    new[1:] = (cls[1:] != cls[:-1]) | (digit[1:] != digit[:-1])
    alone = new & np.append(new[1:], True)
    return (np.cumsum(new) - 1)[~alone], live[~alone]


def settle(group: dict, spec: B.Spec):
    """Windows of one shard that equal an earlier window, by radix passes over their bytes."""
    n = group["windows"].astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = T.expand(np.zeros(len(n), np.int64), n)
    address = group["off"][:-1][row] + place
    cls, live = group["group"][row], np.arange(len(row))
    raw = np.concatenate([group["data"], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), dtype=">u8", buffer=raw.tobytes(), strides=(1,))
    for depth in range(0, spec.length, 8):
        if not len(live):
            break
        digit = eight[address[live] + min(depth, spec.length - 8)].astype(np.uint64)
        cls, live = radix_pass(cls, digit, live)
    again = live[1:][cls[1:] == cls[:-1]] if len(live) else live
    again.sort()
    return B.runs(row[again], place[again])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Byte ranges of ``texts.keyed`` documents covered by a window that also starts earlier."""
    return B.repeats(docs, B.Spec(length, min(MINIMIZER, max(1, length // 3))), settle)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's bytes without the repeated ones, with counts; a row per input row."""
    keyed = T.keyed(docs, id_col, text_col)
    spans = B.spans_by_doc(repeated_spans(keyed, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            loff, f = T.list_of_structs(batch.column("spans"))
            for lo, hi in T.pieces(off):
                part, at = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                pick = slice(loff[lo], loff[hi])
                base = np.repeat(at[:-1], np.diff(loff[lo:hi + 1]))
                gone = B.merged(len(part), f["start"][pick] + base, f["stop"][pick] + base)
                count = np.concatenate([[0], np.cumsum(gone)])
                removed = np.diff(count[at])
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                head[at[:-1][np.diff(at) > 0]] |= gone[at[:-1][np.diff(at) > 0]]
                spans_n = np.diff(np.concatenate([[0], np.cumsum(head)])[at])
                kept = part[~gone]
                koff = at - count[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(removed), pa.array(spans_n),
                     T.string_array(kept, koff[:-1], koff[1:])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = keyed.join(spans, ["doc_id", "copy"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, KEPT_SCHEMA).withColumn("doc_id", T.public_id())
