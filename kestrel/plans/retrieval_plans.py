"""Checks for vector retrieval: L1, P11, W4, A2 (and L2 rows-only)."""

from pyspark.sql import functions as F

from kestrel.operators.retrieval import build_ivf, ivf_recall, threshold, topk_exact, topk_ivf
from kestrel.operators.pseudo import best_per_id
from kestrel.plans.registry import register
from kestrel.plans.sqlparts import topk_hits_cte
from kestrel.sources import driver

K, T = 60, 0.1


def centroid_hits(spark, sf_dir, k=K, t=T):
    vecs = driver.vectors(spark, sf_dir)
    queries = driver.centroid_queries(vecs)
    hits = topk_exact(vecs, queries, k, id_col="id", key_cols=["category"], qvec_col="qvec")
    return threshold(hits, t)


@register("vector_topk", f"""
WITH {topk_hits_cte(K, T)}
SELECT category, id, round(score, 6) AS score, rank::INTEGER AS rank FROM hits
""")
def vector_topk(spark, sf_dir):
    h = centroid_hits(spark, sf_dir)
    return h.select("category", "id", F.round("score", 6).alias("score"), "rank")


@register("best_category", f"""
WITH {topk_hits_cte(K, T)},
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, category) AS rn FROM hits)
  WHERE rn = 1
)
SELECT category, count(*) AS n_reviews, round(avg(score), 6) AS avg_score FROM best GROUP BY category
""")
def best_category(spark, sf_dir):
    best = best_per_id(centroid_hits(spark, sf_dir), "id", "score", "category")
    return best.groupBy("category").agg(F.count(F.lit(1)).alias("n_reviews"),
                                        F.round(F.avg("score"), 6).alias("avg_score"))


@register("ivf_topk")
def ivf_topk(spark, sf_dir):
    """L2 with nprobe = 2 of the default list count; rows-only check (approximate)."""
    vecs = driver.vectors(spark, sf_dir)
    queries = driver.centroid_queries(vecs)
    assigned, cents = build_ivf(vecs)
    hits = topk_ivf(assigned, cents, queries, K, nprobe=2, key_cols=["category"])
    return hits.select("category", "id", F.round("score", 6).alias("score"), "rank")


RECALL_K, RECALL_PROBES = 10, 16


@register("ivf_recall", """
SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0
""")
def ivf_recall_check(spark, sf_dir):
    """L2: every vector indexed; recall of the best 10 at 16 probed lists, queries with an id divisible by 50: 0.9 or more."""
    vecs = driver.vectors(spark, sf_dir)
    queries = vecs.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    found = ivf_recall(*build_ivf(vecs), queries, RECALL_K, RECALL_PROBES)
    return found.select("n_queries", (F.col("recall") >= 0.9).alias("reached"))
