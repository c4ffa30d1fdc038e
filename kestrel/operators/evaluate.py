"""Evaluation.

One pass builds the confusion counts ``(true, pred, n)``; every metric is
SQL arithmetic over at most K x K rows, so the data is scanned once whatever
the number of metrics.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.relational import top_n


def correct_flag(true_col: str = "true_label", pred_col: str = "predicted_label") -> F.Column:
    """equality with null -> false."""
    return F.coalesce(F.col(true_col) == F.col(pred_col), F.lit(False))


def confusion(pred: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """A16 (long form): rows per (true, predicted)."""
    return pred.groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("predicted_label")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, labels: Sequence[str], true_col: str = "true_label",
                     pred_col: str = "predicted_label") -> DataFrame:
    """A16 (wide form): one row per true label, one column per predicted label, zeros filled."""
    return (pred.groupBy(true_col).pivot(pred_col, list(labels)).count().na.fill(0)
            .orderBy(true_col))


def per_class(pred: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """Tp, fp, fn, support, precision, recall, f1 per label (labels = observed true or predicted).

    One pass over the confusion counts: each (true, pred, n) cell contributes
    to its true label (support, tp) and to its predicted label (n_pred).
    """
    cm = confusion(pred, true_col, pred_col)
    t, p_, n = F.col("true_label"), F.col("predicted_label"), F.col("n")
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(t.alias("label"), n.alias("support"), F.when(t == p_, n).otherwise(zero).alias("tp"),
                 zero.alias("n_pred")),
        F.struct(p_.alias("label"), zero.alias("support"), zero.alias("tp"), n.alias("n_pred")))
    out = (cm.select(F.explode(roles).alias("r")).select("r.*").where(F.col("label").isNotNull())
           .groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                 F.sum("n_pred").alias("n_pred")))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return (out.withColumn("f1", f1)
            .select("label", F.col("tp").cast("bigint").alias("tp"),
                    (F.col("n_pred") - F.col("tp")).cast("bigint").alias("fp"),
                    (F.col("support") - F.col("tp")).cast("bigint").alias("fn"),
                    F.col("support").cast("bigint").alias("support"), "precision", "recall", "f1"))


def metrics(pred: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """Accuracy, macro/weighted F1, macro precision and recall, n (one row)."""
    pc = per_class(pred, true_col, pred_col)
    return pc.agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"))


def check_labels(pred: DataFrame, known: DataFrame, true_col: str = "true_label", label_col: str = "label") -> None:
    """Raise if any true label is missing from the label map (lists up to 20)."""
    unknown = (pred.select(F.col(true_col).alias(label_col)).distinct()
               .join(known.select(label_col), label_col, "left_anti").limit(20).collect())
    if unknown:
        raise ValueError(f"labels not in the label map: {sorted(r[0] for r in unknown)}")


def confidence_bin(conf: F.Column, lo: F.Column, hi: F.Column, bins: int = 10) -> F.Column:
    """equal-width bins 1..bins over [lo, hi], right-closed, the minimum in bin 1; lo == hi -> 1."""
    raw = F.ceil((conf - lo) / (hi - lo) * F.lit(bins))
    return F.when(conf.isNull(), F.lit(None)).when(hi == lo, F.lit(1)) \
        .otherwise(F.greatest(F.lit(1), F.least(F.lit(bins), raw))).cast("int")


def calibration(pred: DataFrame, bins: int = 10, by: str | None = None, conf_col: str = "confidence",
                true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """Mean correctness and count per confidence bin (optionally per predicted label)."""
    rng = pred.agg(F.min(conf_col).alias("_lo"), F.max(conf_col).alias("_hi"))
    binned = (pred.crossJoin(F.broadcast(rng))  # one-row scalar
              .withColumn("bin", confidence_bin(F.col(conf_col), F.col("_lo"), F.col("_hi"), bins))
              .withColumn("correct", correct_flag(true_col, pred_col).cast("double"))
              .where(F.col("bin").isNotNull()))
    keys = ([by] if by else []) + ["bin"]
    return binned.groupBy(*keys).agg(F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("n"),
                                     F.avg(conf_col).alias("mean_confidence"))


def training_summary(pred: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_label",
                     conf_col: str = "confidence") -> DataFrame:
    """Accuracy and mean confidence."""
    return pred.agg(F.avg(correct_flag(true_col, pred_col).cast("double")).alias("accuracy"),
                    F.avg(conf_col).alias("mean_confidence"), F.count(F.lit(1)).alias("n"))


def evaluation_report(pred: DataFrame, model_path: str, holdout: str, labels: Sequence[str],
                      true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """One-row nested report (metrics, per-class map, confusion matrix, labels, round)."""
    m = metrics(pred, true_col, pred_col)
    pc = per_class(pred, true_col, pred_col).agg(F.map_from_entries(F.collect_list(F.struct(
        "label", F.struct("precision", "recall", "f1", "support")))).alias("per_class_metrics"))
    cm = confusion(pred, true_col, pred_col)
    lab = F.array(*[F.lit(x) for x in labels])
    grid = cm.agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("\u0001", "true_label", "predicted_label"), "n"))).alias("_m"))
    matrix = F.transform(lab, lambda t: F.transform(lab, lambda p: F.coalesce(
        F.col("_m")[F.concat_ws("\u0001", t, p)], F.lit(0)).cast("bigint")))
    rnd = F.coalesce(F.regexp_extract(F.lit(model_path), r"_r(\d+)", 1), F.lit("0"))
    return (m.crossJoin(pc).crossJoin(grid)  # one-row aggregates (K x K entries at most)
            .select(F.lit(model_path).alias("model_path"), F.lit(holdout).alias("holdout_csv"),
                    F.col("n").alias("total_samples"),
                    F.struct("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro").alias("metrics"),
                    "per_class_metrics", matrix.alias("confusion_matrix"), lab.alias("label_names"),
                    F.when(rnd == "", "0").otherwise(rnd).cast("int").alias("round")))


def sample_predictions(pred: DataFrame, n: int = 10, seed: int = 42, id_col: str = "review_id") -> DataFrame:
    """M9: n seeded-random predictions with correctness."""
    from kestrel.operators.pseudo import seeded_order
    return top_n(pred.withColumn("correct", correct_flag()), n, [seeded_order(id_col, seed).asc(), F.asc(id_col)],
                 spread_by=[id_col]).drop("_rn")


def attach_predictions(rows: DataFrame, pred: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Every row keeps its place; unmatched rows get null predictions (F25 makes them wrong)."""
    return rows.join(pred, id_col, "left")


def by_confidence(pred: DataFrame, conf_col: str = "confidence", id_col: str = "review_id") -> DataFrame:
    """Most confident first, ties by id."""
    return pred.orderBy(F.desc_nulls_last(conf_col), F.asc(id_col))


def label_slice(pred: DataFrame, label: str, n: int = 100, label_col: str = "true_label",
                id_col: str = "review_id", conf_col: str = "confidence") -> DataFrame:
    """The n most confident rows of one true label, ties by id."""
    order = [F.desc_nulls_last(conf_col), F.asc(id_col)]
    return top_n(pred.where(F.col(label_col) == label), n, order, spread_by=[id_col]).orderBy(*order).drop("_rn")


def calibration_report(rows: DataFrame, pred: DataFrame, bins: int = 10, id_col: str = "review_id") -> dict[str, DataFrame]:
    """Join predictions to all rows (J4), order by confidence (L11), flag correctness (F25), bin (A17), also by predicted label."""
    joined = attach_predictions(rows, pred, id_col).withColumn("correct", correct_flag())
    return {"rows": by_confidence(joined, id_col=id_col), "bins": calibration(joined, bins),
            "bins_by_label": calibration(joined, bins, by="predicted_label")}


def stage_counts(**stages: DataFrame) -> DataFrame:
    """Rows per category after each named stage (one aggregate per stage, unioned)."""
    out = None
    for name, df in stages.items():
        c = df.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out
