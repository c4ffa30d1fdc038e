"""Checks for evaluation: F19, F20, F25, F26, A14-A19 over nearest-centroid predictions."""

from pyspark.sql import functions as F

from kestrel.operators.classify import nearest_centroid
from kestrel.operators.evaluate import calibration, confusion, metrics, per_class, training_summary
from kestrel.plans.registry import register
from kestrel.plans.sqlparts import VEC_CTES
from kestrel.sources import driver

TEMPERATURE = 10.0


def centroid_predictions(spark, sf_dir):
    vecs = driver.vectors(spark, sf_dir)
    cents = driver.centroid_queries(vecs)
    pred = nearest_centroid(vecs, cents, TEMPERATURE)
    truth = vecs.select("id", driver.category_name("label").alias("true_label"))
    return pred.join(truth, "id")


PRED_SQL = f"""WITH {VEC_CTES},
lg AS (
  SELECT vn.id, 'label_' || vn.label::VARCHAR AS true_label, cq.category,
         round(list_dot_product(vn.e, cq.q), 12) * {TEMPERATURE} AS z
  FROM vn CROSS JOIN cq
),
sm AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS ez FROM lg),
pr AS (SELECT *, ez / sum(ez) OVER (PARTITION BY id) AS p FROM sm),
pred AS (
  SELECT id, true_label, category AS predicted_label, p AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, category) AS r FROM pr) WHERE r = 1
),
cmx AS (SELECT true_label, predicted_label, count(*) AS n FROM pred GROUP BY ALL),
labs AS (SELECT true_label AS label FROM cmx UNION SELECT predicted_label FROM cmx),
tp AS (SELECT true_label AS label, n AS tp FROM cmx WHERE true_label = predicted_label),
sup AS (SELECT true_label AS label, sum(n) AS support FROM cmx GROUP BY 1),
npr AS (SELECT predicted_label AS label, sum(n) AS n_pred FROM cmx GROUP BY 1),
pc0 AS (
  SELECT l.label, coalesce(tp.tp, 0) AS tp, coalesce(sup.support, 0) AS support, coalesce(npr.n_pred, 0) AS n_pred
  FROM labs l LEFT JOIN tp ON tp.label = l.label LEFT JOIN sup ON sup.label = l.label LEFT JOIN npr ON npr.label = l.label
),
pc1 AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
       FROM pc1)"""


@register("centroid_predictions", f"""{PRED_SQL}
SELECT id, true_label, predicted_label, round(confidence, 6) AS confidence FROM pred
""")
def centroid_predictions_check(spark, sf_dir):
    p = centroid_predictions(spark, sf_dir)
    return p.select("id", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"))


@register("eval_metrics", f"""{PRED_SQL}
SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(precision), 6) AS precision_macro,
       round(avg(recall), 6) AS recall_macro
FROM pc
""")
def eval_metrics(spark, sf_dir):
    m = metrics(centroid_predictions(spark, sf_dir))
    return m.select(F.col("n").cast("bigint").alias("n"),
                    *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


@register("per_class", f"""{PRED_SQL}
SELECT label, tp::BIGINT AS tp, (n_pred - tp)::BIGINT AS fp, (support - tp)::BIGINT AS fn, support::BIGINT AS support,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM pc
""")
def per_class_check(spark, sf_dir):
    pc = per_class(centroid_predictions(spark, sf_dir))
    return pc.select("label", "tp", "fp", "fn", "support",
                     *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("confusion", f"""{PRED_SQL}
SELECT true_label, predicted_label, n FROM cmx
""")
def confusion_check(spark, sf_dir):
    return confusion(centroid_predictions(spark, sf_dir))


CAL_SQL = f"""{PRED_SQL},
rng AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM pred),
bb AS (
  SELECT p.*, (CASE WHEN hi = lo THEN 1 ELSE greatest(1, least(10, ceil((confidence - lo) / (hi - lo) * 10))) END)::INTEGER AS bin,
         (coalesce(true_label = predicted_label, false))::INTEGER::DOUBLE AS correct
  FROM pred p CROSS JOIN rng
)"""


@register("calibration", f"""{CAL_SQL}
SELECT bin, round(avg(correct), 6) AS accuracy, count(*) AS n, round(avg(confidence), 6) AS mean_confidence
FROM bb GROUP BY bin
""")
def calibration_check(spark, sf_dir):
    c = calibration(centroid_predictions(spark, sf_dir), 10)
    return c.select("bin", F.round("accuracy", 6).alias("accuracy"), "n",
                    F.round("mean_confidence", 6).alias("mean_confidence"))


@register("calibration_by_label", f"""{CAL_SQL}
SELECT predicted_label, bin, round(avg(correct), 6) AS accuracy, count(*) AS n,
       round(avg(confidence), 6) AS mean_confidence
FROM bb GROUP BY predicted_label, bin
""")
def calibration_by_label(spark, sf_dir):
    c = calibration(centroid_predictions(spark, sf_dir), 10, by="predicted_label")
    return c.select("predicted_label", "bin", F.round("accuracy", 6).alias("accuracy"), "n",
                    F.round("mean_confidence", 6).alias("mean_confidence"))


@register("train_accuracy", f"""{PRED_SQL}
SELECT round(avg((coalesce(true_label = predicted_label, false))::INTEGER::DOUBLE), 6) AS accuracy,
       round(avg(confidence), 6) AS mean_confidence, count(*) AS n
FROM pred
""")
def train_accuracy(spark, sf_dir):
    t = training_summary(centroid_predictions(spark, sf_dir))
    return t.select(F.round("accuracy", 6).alias("accuracy"), F.round("mean_confidence", 6).alias("mean_confidence"), "n")
