"""Tables of lists by key (postings, lemmas, k-grams), written so that a reader of few keys reads little.

Rows lie in folders by a hash bucket of the key and sorted by key inside.  A hot key is spread over ``SLICES`` files, as the rows are
dealt by a hash of bucket and order.  (Ranges would have the table made twice, once for their bounds.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64
#: Parts that a bucket is written in.
SLICES = 8
#: So many wanted keys are also given to the scan itself.
FEW_KEYS = 1000


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def bucketed(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with its ``bucket``, dealt and sorted for a write partitioned by it."""
    d = df.withColumn("bucket", bucket_of(key))
    dealt = [F.pmod(F.xxhash64(*order), F.lit(SLICES))] if order else []
    return d.repartition("bucket", *dealt).sortWithinPartitions("bucket", key, *order)


def pruned(table: DataFrame, wanted: DataFrame, key: str = "term") -> DataFrame:
    """The part of a ``bucketed`` table that holds the keys of ``wanted``; other tables come back whole.

    At most ``BUCKETS`` bucket numbers and ``FEW_KEYS`` keys reach the driver; they prune folders and row groups, the join that
    follows decides the rows.
    """
    if "bucket" not in table.columns:
        return table
    keys = wanted.select(key).distinct().withColumn("_b", bucket_of(key))
    few = keys.limit(FEW_KEYS + 1).collect()
    if len(few) <= FEW_KEYS:
        if not few:
            return table.limit(0)
        return table.where(F.col("bucket").isin(sorted({r["_b"] for r in few})) & F.col(key).isin([r[key] for r in few]))
    return table.where(F.col("bucket").isin([r[0] for r in keys.select("_b").distinct().collect()]))
