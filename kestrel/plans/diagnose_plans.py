"""Checks for duplicate diagnosis: A20-A23, A25, J6, U3, W9 over vector hits and centroid predictions."""

from pyspark.sql import functions as F

from kestrel.operators.diagnose import (
    category_overlap, duplicate_summary, gate_effect, multi_high_confidence, prediction_coverage,
    score_validity, unexpected_hits,
)
from kestrel.plans.evaluate_plans import PRED_SQL, centroid_predictions
from kestrel.plans.registry import register
from kestrel.plans.retrieval_plans import centroid_hits
from kestrel.plans.sqlparts import topk_hits_cte

GATE_T = 0.5
_TOPK = topk_hits_cte(60, 0.1).replace("v0 AS (", "v0x AS (").replace("FROM v0)", "FROM v0x)")


def _hits(spark, sf_dir):
    return centroid_hits(spark, sf_dir).select(F.col("id").alias("review_id"), "category",
                                               F.col("score").alias("ce_score"))


def _pred(spark, sf_dir):
    return centroid_predictions(spark, sf_dir).withColumnRenamed("id", "review_id")


# predictions (PRED_SQL) and hits share the vector CTEs; hits are re-derived under new names
BOTH = PRED_SQL + """,
sc2 AS (SELECT cq.category, vn.id, round(list_dot_product(vn.e, cq.q), 9) AS score FROM vn CROSS JOIN cq),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS rank FROM sc2),
hh AS (SELECT category, id AS review_id, score AS ce_score FROM rk2 WHERE rank <= 60 AND score >= 0.1),
cnt AS (SELECT review_id, count(*) AS n FROM hh GROUP BY review_id),
dup AS (SELECT review_id FROM cnt WHERE n > 1)"""


@register("duplicate_summary", BOTH + """
SELECT sum(n)::BIGINT AS total, count(*) AS distinct_ids, count_if(n > 1) AS duplicated_ids,
       coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS duplicate_rows,
       round(100.0 * count_if(n > 1) / count(*), 6) AS pct_duplicated_ids,
       round(100.0 * coalesce(sum(CASE WHEN n > 1 THEN n END), 0) / sum(n), 6) AS pct_duplicate_rows
FROM cnt
""")
def duplicate_summary_check(spark, sf_dir):
    s = duplicate_summary(_hits(spark, sf_dir))
    return s.select("total", "distinct_ids", "duplicated_ids", "duplicate_rows",
                    F.round("pct_duplicated_ids", 6).alias("pct_duplicated_ids"),
                    F.round("pct_duplicate_rows", 6).alias("pct_duplicate_rows"))


@register("category_overlap", BOTH + """,
sets AS (SELECT review_id, list_sort(list(category)) AS categories FROM hh GROUP BY review_id HAVING count(*) > 1)
SELECT array_to_string(categories, ',') AS categories, count(*) AS n FROM sets GROUP BY categories
""")
def category_overlap_check(spark, sf_dir):
    o = category_overlap(_hits(spark, sf_dir))
    return o.select(F.array_join("categories", ",").alias("categories"), "n")


@register("prediction_coverage", BOTH + """
SELECT (SELECT count(*) FROM dup) AS duplicated_ids,
       (SELECT count(*) FROM dup WHERE review_id IN (SELECT id FROM pred)) AS with_prediction,
       round((SELECT count(*) FROM dup WHERE review_id IN (SELECT id FROM pred)) / (SELECT count(*) FROM dup), 6) AS coverage
""")
def prediction_coverage_check(spark, sf_dir):
    c = prediction_coverage(_hits(spark, sf_dir), _pred(spark, sf_dir))
    return c.select("duplicated_ids", "with_prediction", F.round("coverage", 6).alias("coverage"))


@register("unexpected_hits", BOTH + f""",
ret AS (SELECT review_id, list_sort(list(DISTINCT category)) AS retrieved FROM hh
        WHERE review_id IN (SELECT review_id FROM dup) GROUP BY review_id),
ex AS (
  SELECT r.review_id, r.retrieved, p.predicted_label, p.confidence,
         CASE WHEN p.confidence >= {GATE_T} THEN [p.predicted_label] ELSE []::VARCHAR[] END AS expected
  FROM ret r JOIN pred p ON p.id = r.review_id
),
un AS (SELECT *, list_filter(retrieved, lambda c: NOT list_contains(expected, c)) AS unexpected FROM ex)
SELECT review_id, array_to_string(retrieved, ',') AS retrieved, array_to_string(unexpected, ',') AS unexpected,
       predicted_label, round(confidence, 6) AS confidence
FROM un WHERE len(unexpected) > 0
""")
def unexpected_hits_check(spark, sf_dir):
    u = unexpected_hits(_hits(spark, sf_dir), _pred(spark, sf_dir), GATE_T)
    return u.select("review_id", F.array_join("retrieved", ",").alias("retrieved"),
                    F.array_join(F.array_sort("unexpected"), ",").alias("unexpected"), "predicted_label",
                    F.round("confidence", 6).alias("confidence"))


@register("gate_effect", BOTH + f""",
g AS (SELECT h.category, coalesce(p.predicted_label = h.category AND p.confidence >= {GATE_T}, false) AS pass
      FROM hh h LEFT JOIN pred p ON p.id = h.review_id)
SELECT category, count(*) AS retrieved, count_if(pass) AS kept, count(*) - count_if(pass) AS removed,
       round(100.0 * count_if(pass) / count(*), 6) AS pct_kept, count(*) - count_if(pass) = 0 AS no_effect,
       count_if(pass) < 50 AS fallback_all
FROM g GROUP BY category
""")
def gate_effect_check(spark, sf_dir):
    g = gate_effect(_hits(spark, sf_dir), _pred(spark, sf_dir), GATE_T)
    return g.select("category", "retrieved", "kept", "removed", F.round("pct_kept", 6).alias("pct_kept"),
                    "no_effect", "fallback_all")


@register("multi_high_conf", BOTH + f""",
hc AS (SELECT id, count_if(p >= {GATE_T}) AS k FROM pr GROUP BY id)
SELECT count_if(k > 1) AS multi_high_conf, count(*) AS duplicated_with_pred
FROM hc WHERE id IN (SELECT review_id FROM dup)
""")
def multi_high_conf_check(spark, sf_dir):
    return multi_high_confidence(_hits(spark, sf_dir), _pred(spark, sf_dir), GATE_T)


@register("score_validity", BOTH + """
SELECT count(*) AS n, count_if(isnan(ce_score)) AS n_nan,
       min(CASE WHEN NOT isnan(ce_score) THEN ce_score END) AS min_score,
       max(CASE WHEN NOT isnan(ce_score) THEN ce_score END) AS max_score
FROM hh
""")
def score_validity_check(spark, sf_dir):
    return score_validity(_hits(spark, sf_dir))
