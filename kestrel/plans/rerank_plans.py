"""Checks for text retrieval and re-ranking: M1-M5, L3, P12, W5, W7, W8, A11."""

from functools import lru_cache

from pyspark.sql import functions as F

from kestrel.operators.beams import beam_means, merge_beams
from kestrel.operators.rerank import blend, bm25, build_index, rerank, retrieve
from kestrel.plans.registry import register
from kestrel.plans.sqlparts import bm25_sql, retrieve_sql, sparse_index_sql
from kestrel.sources import driver

# Fixed test configuration: one category per language of `documents`, three
# beam queries each (a round-1 shape: the seed word plus one expansion word).
BEAM_QUERIES = [
    ("de", 1, "sich"), ("de", 2, "sich nicht"), ("de", 3, "sich eine"),
    ("en", 1, "rewh"), ("en", 2, "rewh orre"), ("en", 3, "rewh thatin"),
    ("es", 1, "para"), ("es", 2, "para mente"), ("es", 3, "para ción"),
    ("fr", 1, "pour"), ("fr", 2, "pour dans"), ("fr", 3, "pour avec"),
]
K1, K2, CE_T = 50, 30, 2.0
KEYS = ["category", "beam_id"]

_VALUES = ", ".join(f"('{c}', {b}, '{q}')" for c, b, q in BEAM_QUERIES)


def beam_query_df(spark):
    return spark.createDataFrame(BEAM_QUERIES, "category string, beam_id int, query string")


def index_for(spark, sf_dir):
    from kestrel.plans.corpus_cache import corpus_for
    return corpus_for(spark, sf_dir).index


def first_stage(spark, sf_dir, k=K1):
    idx = index_for(spark, sf_dir)
    q = beam_query_df(spark)
    hits = retrieve(idx, q, k, KEYS).join(q, KEYS)
    return idx, hits


def reranked(spark, sf_dir):
    idx, hits = first_stage(spark, sf_dir)
    scored = bm25(idx, hits, KEYS, "query")
    return rerank(scored, K2, CE_T, KEYS)


BASE = f"WITH {sparse_index_sql()}, {retrieve_sql(_VALUES, K1)}"
CE = f"{BASE}, {bm25_sql()}"
RERANKED = f"""{CE},
rr AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ce_score DESC, rank) AS ce_rank FROM ce)
  WHERE ce_rank <= {K2} AND ce_score >= {CE_T}
)"""


@register("sparse_topk", f"""{BASE}
SELECT category, beam_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM hits
""")
def sparse_topk(spark, sf_dir):
    _, hits = first_stage(spark, sf_dir)
    return hits.select("category", "beam_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("bm25_rerank", f"""{RERANKED}
SELECT category, beam_id, doc_id, round(ce_score, 6) AS ce_score, ce_rank::INTEGER AS ce_rank FROM rr
""")
def bm25_rerank(spark, sf_dir):
    r = reranked(spark, sf_dir)
    return r.select("category", "beam_id", "doc_id", F.round("ce_score", 6).alias("ce_score"), "ce_rank")


@register("score_blend", f"""{CE},
mm AS (
  SELECT *, min(ce_score) OVER (PARTITION BY pid) AS clo, max(ce_score) OVER (PARTITION BY pid) AS chi,
         min(score) OVER (PARTITION BY pid) AS slo, max(score) OVER (PARTITION BY pid) AS shi FROM ce
)
SELECT category, beam_id, doc_id,
       round(0.8 * (CASE WHEN chi > clo THEN (ce_score - clo) / (chi - clo) ELSE ce_score END)
             + 0.19999999999999996 * (CASE WHEN shi > slo THEN (score - slo) / (shi - slo) ELSE score END), 6) AS blended
FROM mm
""")
def score_blend(spark, sf_dir):
    idx, hits = first_stage(spark, sf_dir)
    b = blend(bm25(idx, hits, KEYS, "query"), KEYS, "ce_score", "score", 0.8)
    return b.select("category", "beam_id", "doc_id", F.round("blended", 6).alias("blended"))


@register("beam_union", f"""{RERANKED},
u AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, doc_id ORDER BY ce_score DESC, beam_id) AS r FROM rr)
  WHERE r = 1
)
SELECT category, doc_id, beam_id, round(ce_score, 6) AS ce_score FROM u
""")
def beam_union(spark, sf_dir):
    m = merge_beams(reranked(spark, sf_dir), "union", "doc_id")
    return m.select("category", "doc_id", "beam_id", F.round("ce_score", 6).alias("ce_score"))


@register("beam_means", f"""{RERANKED}
SELECT category, beam_id, round(avg(ce_score), 6) AS avg_score, count(*) AS n FROM rr GROUP BY category, beam_id
""")
def beam_means_check(spark, sf_dir):
    m = beam_means(reranked(spark, sf_dir))
    return m.select("category", "beam_id", F.round("avg_score", 6).alias("avg_score"), "n")


@register("top_beam", f"""{RERANKED},
bmn AS (SELECT category, beam_id, avg(ce_score) AS a FROM rr GROUP BY category, beam_id),
best AS (
  SELECT category, beam_id FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY a DESC, beam_id) AS r FROM bmn) WHERE r = 1
)
SELECT rr.category, rr.beam_id, rr.doc_id, round(rr.ce_score, 6) AS ce_score
FROM rr JOIN best ON rr.category = best.category AND rr.beam_id = best.beam_id
""")
def top_beam(spark, sf_dir):
    m = merge_beams(reranked(spark, sf_dir), "top_beam", "doc_id")
    return m.select("category", "beam_id", "doc_id", F.round("ce_score", 6).alias("ce_score"))


@register("beam_first", f"""{RERANKED},
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, doc_id ORDER BY beam_id) AS r FROM rr) WHERE r = 1)
SELECT category, doc_id, beam_id, round(ce_score, 6) AS ce_score FROM u
""")
def beam_first(spark, sf_dir):
    m = merge_beams(reranked(spark, sf_dir), "first", "doc_id")
    return m.select("category", "doc_id", "beam_id", F.round("ce_score", 6).alias("ce_score"))
