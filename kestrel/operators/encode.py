"""Dense text vectors (M1, M2): a hashed default encoder and a plug for a user's batch function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.text import tokens
from kestrel.functions.vectors import l2_normalize
from kestrel.session import spread


def hash_embed(df: DataFrame, text_col: str = "text", dim: int = 256, out: str = "embedding") -> DataFrame:
    """Unit vector of hashed word counts; a text without words is the zero vector.  No shuffle.

    A word's place is the first 24 bits of its md5, a hash that any engine has, taken in the JVM; the tasks only count places.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, n = batch.column(batch.num_columns - 1), len(batch)
            row = np.repeat(np.arange(n), col.value_lengths().to_numpy())
            counts = np.bincount(row * dim + col.flatten().to_numpy(), minlength=n * dim).astype(np.float64)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], [*names, out])

    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    place = F.transform(tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda t: (F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long") % dim))
    return spread(df.withColumn("_places", place)).mapInArrow(run, schema).withColumn(out, l2_normalize(out))


def embed(df: DataFrame, text_col: str = "text", encoder: Callable[[Sequence[str]], np.ndarray] | None = None,
          out: str = "embedding", batch: int = 32, dim: int = 256) -> DataFrame:
    """M1: ``df`` with a unit vector per text: hashed words, or ``encoder`` called on ``batch`` texts at a time.

    A null text is encoded as the empty text.  The encoder runs in the tasks, on one Arrow batch after another.
    """
    if encoder is None:
        return hash_embed(df, text_col, dim, out)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = pdf[text_col].fillna("").tolist()
            rows = [np.asarray(encoder(texts[lo:lo + batch]), dtype=np.float64) for lo in range(0, len(texts), batch)]
            yield pdf.assign(**{out: [v for r in rows for v in r]})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return spread(df).mapInPandas(run, schema).withColumn(out, l2_normalize(out))
