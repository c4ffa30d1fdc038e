"""Deterministic stratified splits (L7-L10) and exact seeded samples.

Every row gets a pseudo-random key ``md5(seed:id)``.  A stratum's rows are
ranked by that key and cut at counts derived from the stratum size, so sizes
are exact and the same rows are chosen by any engine that has md5.

No stratum is ever sorted in one task: the key's first hex digits split each
stratum into ``16**prefix`` buckets.  Bucket counts come from a partial
aggregate; a running sum over the (small) bucket table gives each bucket's
offset; rows are then ranked only inside their bucket, with the window and
the bucket join sharing one hash partitioning on (stratum, bucket).  A
stratum holding a third of all rows is thus spread over 65,536 tasks' worth
of keys.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.pseudo import seeded_order
from kestrel.operators.relational import null_safe_join
from kestrel.session import cut_lineage

PREFIX_HEX = 4  # 65,536 buckets per stratum


def _ranked(df: DataFrame, id_col: str, stratum: str | None, seed: int, prefix: int = PREFIX_HEX) -> DataFrame:
    """Adds ``_n`` (stratum size) and ``_rank`` (1-based rank by seeded key, then id)."""
    s_col = F.col(stratum) if stratum else F.lit(0)
    keyed = (df.withColumn("_s", s_col)
             .withColumn("_key", seeded_order(id_col, seed))
             .withColumn("_b", F.conv(F.substring("_key", 1, prefix), 16, 10).cast("int")))
    buckets = keyed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    per_stratum = Window.partitionBy("_s")
    running = per_stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (buckets.withColumn("_off", F.coalesce(F.sum("_cnt").over(running), F.lit(0)))
               .withColumn("_n", F.sum("_cnt").over(per_stratum)).drop("_cnt"))
    within = Window.partitionBy("_s", "_b").orderBy("_key", id_col)
    # rows without a stratum are a stratum of their own
    return (null_safe_join(keyed, buckets, ["_s", "_b"])
            .withColumn("_rank", F.col("_off") + F.row_number().over(within))
            .drop("_off", "_key", "_b"))


def split_by_counts(df: DataFrame, id_col: str, stratum: str | None, cuts: list[tuple[str, Callable[[Column], Column]]],
                    rest: str, seed: int = 42, out: str = "split") -> DataFrame:
    """Assign names by rank: the first ``cut_1(n)`` ranks get name 1, the next ``cut_2(n)`` name 2, ..., else ``rest``."""
    r = _ranked(df, id_col, stratum, seed)
    n = F.col("_n")
    expr = None
    upto = F.lit(0)
    for name, fn in cuts:
        upto = upto + fn(n)
        cond = F.col("_rank") <= upto
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(rest)) if expr is not None else F.lit(rest)
    return r.withColumn(out, expr).drop("_s", "_n", "_rank")


def _round_count(n: Column, frac: float) -> Column:
    return F.round(n.cast("double") * F.lit(frac)).cast("bigint")


def train_dev_test_split(df: DataFrame, id_col: str, stratum: str | None = None, dev_size: float = 0.15,
                         test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Test first (round(n*test)), then dev = round(rest*dev/(1-test)), rest train; per stratum."""
    dev_ratio = dev_size / (1 - test_size)

    def test_n(n):
        return _round_count(n, test_size)

    def dev_n(n):
        return _round_count(n - test_n(n), dev_ratio)

    return split_by_counts(df, id_col, stratum, [("test", test_n), ("dev", dev_n)], "train", seed)


def train_holdout_split(df: DataFrame, id_col: str, stratum: str | None = None, holdout_size: float = 0.2,
                        seed: int = 42) -> DataFrame:
    """Two-way stratified split, holdout = round(n*size) per stratum."""
    return split_by_counts(df, id_col, stratum, [("holdout", lambda n: _round_count(n, holdout_size))],
                           "train", seed)


def tiny_class_split(df: DataFrame, id_col: str, label_col: str, val_frac: float, seed: int = 42) -> DataFrame:
    """``n_val = max(1, floor(n*frac))`` per class (a one-row class goes to val).

    If no row lands in train, the first half of the validation rows (class
    order, then rank) move to train.  Rows without a label are left out, as a group-by on
    the label leaves them out; ``unlabelled_count`` tells how many.
    """
    def val_n(n):
        return F.when(n > 1, F.greatest(F.lit(1), F.floor(n.cast("double") * F.lit(val_frac)))).otherwise(F.lit(1)).cast("bigint")

    r = _ranked(df.where(F.col(label_col).isNotNull()), id_col, label_col, seed)
    out = r.withColumn("split", F.when(F.col("_rank") <= val_n(F.col("_n")), "val").otherwise("train"))
    out = cut_lineage(out.drop("_n", "_s"))
    if out.where(F.col("split") == "train").isEmpty():
        # a row's place is its rank behind the classes before its own: only the K classes are ordered in one task
        sizes = out.groupBy(label_col).agg(F.count(F.lit(1)).alias("_size"))
        before = Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
        total = out.count()
        out = (out.join(sizes, label_col)
               .withColumn("split", F.when(F.col("_before") + F.col("_rank") <= F.lit(total // 2), "train").otherwise("val"))
               .drop("_before"))
    return out.drop("_rank")


def unlabelled_count(df: DataFrame, label_col: str) -> DataFrame:
    """Rows that ``tiny_class_split`` leaves out."""
    return df.agg(F.count_if(F.col(label_col).isNull()).alias("n_unlabelled"))


def split_report(df: DataFrame, stratum: str | None, split_col: str = "split") -> DataFrame:
    """Rows per (split, stratum)."""
    keys = [split_col] + ([stratum] if stratum else [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
