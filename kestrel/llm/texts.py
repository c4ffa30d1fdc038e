"""Documents as the operators see them: keys that are unique, and Arrow text as NumPy bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

#: Stands for a null id, so that it orders before every other.
NULL_ID = -(1 << 63)
CHUNK = 1 << 21


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, and a key: ``_id``, ``_copy`` and ``_listing``.

    A null id becomes ``NULL_ID``; a null text counts as the empty text.  Ids are nearly always
    unique; where one repeats, its different texts are numbered by ``_copy`` in text order, and rows
    that agree in both are one document listed several times, numbered by ``_listing`` from 1.
    """
    d = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)))
    if d.groupBy("_id").count().where("count > 1").isEmpty():
        return d.withColumn("_copy", F.lit(0)).withColumn("_listing", F.lit(1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = Window.partitionBy("_id", text).orderBy(F.lit(0))
    return (d.withColumn("_copy", F.dense_rank().over(Window.partitionBy("_id").orderBy(text)) - 1)
            .withColumn("_listing", F.row_number().over(same)))


def carried(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its columns numbered, its ``_text`` and the key of ``with_keys``: no input column can clash with an operator's own.

    ``restored`` gives the columns back.  (One struct would do as well, but would read columns that nobody asks for.)
    """
    named = docs.select("*", F.col(id_col).alias("_own"), F.col(text_col).alias("_text"))
    return with_keys(named.toDF(*(f"_in{i}" for i in range(len(docs.columns))), "_own", "_text"), "_own", "_text")


def restored(docs: DataFrame) -> dict[str, Column]:
    """The columns of ``docs`` in a table that ``carried`` made of it."""
    return {c: F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)}


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, listing, text) of every row by ``with_keys``; other columns are left out."""
    return with_keys(docs.select(id_col, text_col), id_col, text_col).select(
        F.col("_id").alias("doc_id"), F.col("_copy").alias("copy"), F.col("_listing").alias("listing"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def distinct(keyed_docs: DataFrame) -> DataFrame:
    """The first listing of every document."""
    return keyed_docs.where("listing = 1").select("doc_id", "copy", "text")


def public_id(col: str = "doc_id"):
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col)).alias(col)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column without nulls, and its n + 1 offsets."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def string_array(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind=pa.binary()) -> pa.Array:
    """data[start:stop) for each pair, as one Arrow column."""
    lens = stops - starts
    off = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lens, out=off[1:])
    body = data[expand(starts, lens)]
    big = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(body))])
    return big.cast(kind)


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def list_of_structs(col: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and flat fields of an array<struct> column; a null list is empty."""
    off = np.zeros(len(col) + 1, dtype=np.int64)
    lens = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    np.cumsum(lens, out=off[1:])
    flat = col.flatten()
    return off, {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
