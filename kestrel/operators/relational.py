"""Joins and top-n shared by the operators."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many rows a window over a group is limited on the map side by Spark itself.
WINDOW_LIMIT = 1000
#: Rows of a group are ranked in so many parts first, then the survivors in fewer.
TOURNAMENT = (1024, 32)
#: Rows of a table that are sent to all tasks.
SENT = 200_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; key columns come from ``left``."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def join_frequent(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key; ``by``: how frequent it is).  A table of up to ``SENT`` rows is sent to all tasks; of a larger
    one the ``SENT`` most frequent keys are, and only the rows of other keys are shuffled.  Call it on written tables: both are read again."""
    if table.count() <= SENT:
        return rows.join(F.broadcast(table), key)
    often = table.orderBy(F.desc(by), F.asc(key)).limit(SENT)
    cut = often.agg(F.min(by)).first()[0]
    often, seldom = table.where(F.col(by) > cut), table.where(F.col(by) <= cut)  # more frequent than the last: SENT at most
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(rest.join(seldom, key))


def top_n(df: DataFrame, n: int, order: Sequence[Column], group_cols: Sequence[str] = (), spread_by: Sequence[str] = (),
          rank_col: str = "_rn") -> DataFrame:
    """The first ``n`` rows of every group, with their rank.

    No group is ranked in one task, whatever ``n`` is: it is dealt into ``TOURNAMENT[0]`` parts by a hash
    of ``spread_by``, each part keeps its first n, the survivors meet in fewer parts, and at last n rows per
    remaining part are ranked together.
    """
    g = list(group_cols)
    part = F.xxhash64(*spread_by)
    out = df
    for parts in TOURNAMENT:
        out = out.withColumn("_part", F.pmod(part, F.lit(parts)))
        w = Window.partitionBy(*g, "_part").orderBy(*order)
        out = out.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n).drop(rank_col, "_part")
    w = Window.partitionBy(*(g or [F.lit(0)])).orderBy(*order)
    return out.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def best_n(df: DataFrame, n: int, order: Sequence[Column], group_cols: Sequence[str], spread_by: Sequence[str], rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group: one limited window where Spark limits it before the shuffle, else ``top_n``."""
    if n > WINDOW_LIMIT:
        return top_n(df, n, order, group_cols, spread_by, rank_col)
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def late_rows(df: DataFrame, narrow: Sequence[Column], choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``df`` that ``choose`` picks from the ``narrow`` columns alone: whole rows are fetched only for the picked ones.

    A row is known by two 64-bit hashes of all its columns.  Rows that agree in everything are one row picked several times.
    ``df`` is read twice, its wide columns are moved only for what is picked.
    """
    cols = df.columns
    hashes = [F.xxhash64(F.lit(1), *cols).alias("_h1"), F.xxhash64(F.lit(2), *cols).alias("_h2")]
    picked = choose(df.select(*narrow, *hashes)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_times"))
    rows = df.select("*", *hashes).join(picked, ["_h1", "_h2"]).dropDuplicates(["_h1", "_h2"])
    return rows.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_again")).drop("_again")
