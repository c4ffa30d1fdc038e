"""Duplicate-retrieval diagnosis and data audits (G11: A20-A25, J6, U2, U3, W9, W10).

All per-id work is a ``groupBy`` (partial aggregation) over the retrieval
table; nothing is collected per id, and a document retrieved by every
category costs one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import overlap_words
from kestrel.operators.predictions import dedupe_predictions


def per_id_counts(hits: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Retrievals per id (``keep=False`` duplicates are ids with n > 1)."""
    return hits.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))


def duplicate_summary(hits: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Total rows, distinct ids, ids retrieved more than once, their rows, and percentages."""
    c = per_id_counts(hits, id_col)
    s = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_ids"),
              F.count_if(F.col("n") > 1).alias("duplicated_ids"),
              F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))
    return (s.withColumn("pct_duplicated_ids", F.when(F.col("distinct_ids") > 0,
                                                      100.0 * F.col("duplicated_ids") / F.col("distinct_ids")))
            .withColumn("pct_duplicate_rows", F.when(F.col("total") > 0,
                                                     100.0 * F.col("duplicate_rows") / F.col("total")))
            .select(F.col("total").cast("bigint").alias("total"), "distinct_ids", "duplicated_ids",
                    F.col("duplicate_rows").cast("bigint").alias("duplicate_rows"),
                    "pct_duplicated_ids", "pct_duplicate_rows"))


def category_overlap(hits: DataFrame, id_col: str = "review_id", category_col: str = "category") -> DataFrame:
    """Sorted category lists of duplicated ids, counted, most frequent first."""
    per_id = (hits.groupBy(id_col).agg(F.sort_array(F.collect_list(category_col)).alias("categories"))
              .where(F.size("categories") > 1))
    return (per_id.groupBy("categories").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(F.array_join("categories", "\u0001"))))


def duplicated_ids(hits: DataFrame, id_col: str = "review_id") -> DataFrame:
    return per_id_counts(hits, id_col).where(F.col("n") > 1).select(id_col)


def prediction_coverage(hits: DataFrame, predictions: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Duplicated ids, how many have a prediction, and the ratio."""
    dup = duplicated_ids(hits, id_col)
    with_pred = dup.join(predictions.select(id_col).distinct(), id_col, "left_semi")
    a = dup.agg(F.count(F.lit(1)).alias("duplicated_ids"))
    b = with_pred.agg(F.count(F.lit(1)).alias("with_prediction"))
    return a.crossJoin(b).withColumn(  # two one-row aggregates
        "coverage", F.when(F.col("duplicated_ids") > 0, F.col("with_prediction") / F.col("duplicated_ids")))


def unexpected_hits(hits: DataFrame, predictions: DataFrame, threshold: float = 0.5, id_col: str = "review_id",
                    category_col: str = "category", order_col: str | None = None) -> DataFrame:
    """For duplicated ids with a prediction, retrieved categories the gate would not pass
    (expected = the predicted label when its confidence >= threshold)."""
    dup = duplicated_ids(hits, id_col)
    retrieved = (hits.join(dup, id_col, "left_semi")
                 .groupBy(id_col).agg(F.sort_array(F.collect_set(category_col)).alias("retrieved")))
    p = dedupe_predictions(predictions, id_col, order_col).select(id_col, "predicted_label", "confidence")
    expected = F.when(F.col("confidence") >= F.lit(threshold), F.array("predicted_label")) \
        .otherwise(F.array().cast("array<string>"))
    return (retrieved.join(p, id_col)
            .withColumn("expected", expected)
            .withColumn("unexpected", F.array_except("retrieved", "expected"))
            .where(F.size("unexpected") > 0)
            .select(id_col, "retrieved", "expected", "unexpected", "predicted_label", "confidence"))


def gate_effect(hits: DataFrame, predictions: DataFrame, threshold: float = 0.5, min_docs: int = 50,
                id_col: str = "review_id", category_col: str = "category", order_col: str | None = None) -> DataFrame:
    """Per category retrieved, passing the gate, removed, % kept, no-effect and fallback flags."""
    p = dedupe_predictions(predictions, id_col, order_col).select(id_col, "predicted_label", "confidence")
    g = (hits.join(p, id_col, "left")
         .withColumn("_pass", F.coalesce((F.col("predicted_label") == F.col(category_col))
                                         & (F.col("confidence") >= F.lit(threshold)), F.lit(False))))
    out = g.groupBy(category_col).agg(F.count(F.lit(1)).alias("retrieved"), F.count_if("_pass").alias("kept"))
    return (out.withColumn("removed", F.col("retrieved") - F.col("kept"))
            .withColumn("pct_kept", F.when(F.col("retrieved") > 0, 100.0 * F.col("kept") / F.col("retrieved")))
            .withColumn("no_effect", F.col("removed") == 0)
            .withColumn("fallback_all", F.col("kept") < F.lit(min_docs)))


def multi_high_confidence(hits: DataFrame, predictions: DataFrame, threshold: float = 0.5,
                          id_col: str = "review_id", probs_col: str = "probs", order_col: str | None = None) -> DataFrame:
    """Duplicated ids whose probabilities reach the threshold for more than one class."""
    dup = duplicated_ids(hits, id_col)
    n_high = F.size(F.filter(F.map_values(probs_col), lambda x: x >= F.lit(threshold)))
    return (dedupe_predictions(predictions, id_col, order_col).join(dup, id_col, "left_semi")
            .agg(F.count_if(n_high > 1).alias("multi_high_conf"), F.count(F.lit(1)).alias("duplicated_with_pred")))


def score_validity(scores: DataFrame, score_col: str = "ce_score") -> DataFrame:
    """NaN count, rows, min and max (ignoring NaN) of a score column."""
    x = F.col(score_col)
    ok = F.when(~F.isnan(x), x)
    return scores.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(x)).alias("n_nan"),
                      F.min(ok).alias("min_score"), F.max(ok).alias("max_score"))


def invalid_scores(scores: DataFrame, score_col: str = "ce_score") -> DataFrame:
    """The rows whose score is NaN."""
    return scores.where(F.isnan(score_col))


def duplicate_detail(hits: DataFrame, predictions: DataFrame, threshold: float = 0.5, id_col: str = "review_id",
                     category_col: str = "category", order_col: str | None = None) -> DataFrame:
    """Every duplicated id with its categories, its prediction if any, and which of them pass the gate."""
    dup = duplicated_ids(hits, id_col)
    retrieved = (hits.join(dup, id_col, "left_semi").groupBy(id_col)
                 .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(category_col)).alias("retrieved")))
    p = dedupe_predictions(predictions, id_col, order_col).select(id_col, "predicted_label", "confidence")
    passes = F.filter("retrieved", lambda c: (c == F.col("predicted_label")) & (F.col("confidence") >= threshold))
    return (retrieved.join(p, id_col, "left")
            .withColumn("passing", F.coalesce(passes, F.array().cast("array<string>")))
            .withColumn("unexpected", F.array_except("retrieved", "passing")))


def similarity_audit(hits: DataFrame, query_col: str = "query", text_col: str = "text",
                     sim_col: str = "score", keys=("category", "beam_id"), id_col: str = "doc_id",
                     alert_at: float = 0.7) -> DataFrame:
    """W10 + U2: rank in similarity order, relevance flag (rank <= 2 and sim > 0.5), shared words,
    and an alert when sim > ``alert_at`` with no shared word."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sim_col), F.asc(id_col))
    shared = overlap_words(F.col(query_col), F.col(text_col))
    return (hits.withColumn("sim_rank", F.row_number().over(w))
            .withColumn("relevant", (F.col("sim_rank") <= 2) & (F.col(sim_col) > 0.5))
            .withColumn("shared_words", F.size(shared))
            .withColumn("alert", (F.col(sim_col) > alert_at) & (F.size(shared) == 0)))
