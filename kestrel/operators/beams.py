"""Beam handling: carry-over of expanded queries (J12), beam merge strategies
(W5 union, W7 top beam, W8 first occurrence) and mean score per beam (A11).

Beams are a column, never separate DataFrames: all categories and beams are
processed in one job.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.operators.pseudo import best_per_id
from kestrel.session import cut_lineage

STRATEGIES = ("union", "top_beam", "first")


def initial_beams(spark: SparkSession, categories: dict[str, str] | Sequence[str], num_beams: int) -> DataFrame:
    """J12 default: every beam of a category starts from its seed query (the name by default)."""
    items = categories.items() if isinstance(categories, dict) else [(c, c) for c in categories]
    rows = [(c, b, q) for c, q in items for b in range(1, num_beams + 1)]
    return spark.createDataFrame(rows, "category string, beam_id int, query string")


def carry_over(current: DataFrame, previous: DataFrame | None, num_beams: int) -> DataFrame:
    """Take the previous round's expanded queries by (category, beam_id), up to ``num_beams``;
    beams without one keep their seed query."""
    cur = current.where(F.col("beam_id") <= num_beams)
    if previous is None:
        return cur
    if "beam_id" not in previous.columns:  # the old form: one expanded query per category, for all its beams
        one = previous.groupBy("category").agg(F.min("expanded_query").alias("_prev"))
        return cur.join(one, "category", "left").withColumn("query", F.coalesce("_prev", "query")).drop("_prev")
    prev = previous.select("category", "beam_id", F.col("expanded_query").alias("_prev"))
    return (cur.join(prev, ["category", "beam_id"], "left")
            .withColumn("query", F.coalesce(F.col("_prev"), F.col("query"))).drop("_prev"))


def beam_means(hits: DataFrame, score_col: str = "ce_score") -> DataFrame:
    """Mean score and size per (category, beam)."""
    return hits.groupBy("category", "beam_id").agg(F.avg(score_col).alias("avg_score"),
                                                   F.count(F.lit(1)).alias("n"))


def merge_beams(hits: DataFrame, strategy: str = "union", id_col: str = "review_id",
                score_col: str = "ce_score") -> DataFrame:
    """One row per (category, document).

    * ``union``: best score over beams, lowest beam id on ties;
    * ``top_beam``: only the beam with the highest mean score (empty beams never
      win; ties -> lowest beam id);
    * ``first``: first occurrence in beam order.
    """
    if strategy == "union":
        return best_per_id(hits, ["category", id_col], score_col, "beam_id").select(*hits.columns)
    if strategy == "top_beam":
        hits = cut_lineage(hits)  # bounded by beams x k; read twice (means, rows)
        means = beam_means(hits, score_col)
        w = Window.partitionBy("category").orderBy(F.desc("avg_score"), F.asc("beam_id"))
        chosen = means.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("category", "beam_id")
        return hits.join(F.broadcast(chosen), ["category", "beam_id"])  # one row per category
    if strategy == "first":
        b = hits.groupBy("category", id_col).agg(F.min(F.struct(F.col("beam_id").alias("_o"), *hits.columns)).alias("_b"))
        return b.select(*[F.col(f"_b.{c}").alias(c) for c in hits.columns])
    raise ValueError(f"unknown beam strategy {strategy!r}; use one of {STRATEGIES}")
