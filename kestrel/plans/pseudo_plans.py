"""Checks for pseudo-labels: P13, W2, W3, W4, W6, F24, G6, G9, A24."""

from pyspark.sql import functions as F

from kestrel.operators.beams import merge_beams
from kestrel.operators.pseudo import (
    best_per_id, dedup_effect, dedup_text, legacy_training_set, nonempty_text, pseudo_labels,
    random_cap_per_class,
)
from kestrel.plans.registry import register
from kestrel.plans.rerank_plans import RERANKED, reranked
from kestrel.plans.sqlparts import WS_CLASS, sql_list
from kestrel.session import cut_lineage
from kestrel.sources import driver

CAP = 25
RANDOM_CAP = 10
BASE_LABELS = ["e", "en", "fr", "r"]


def labelled_hits(spark, sf_dir):
    """The merged text hits of all beams as retrieval output: (review_id, label, ce_score, cosine_similarity, text)."""
    docs = driver.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text")
    merged = merge_beams(reranked(spark, sf_dir), "union", "doc_id")
    # written before and after: the rows are few (categories x beams x k); their size is known when they meet the corpus, whose texts then stay
    # where they are, and what is asked of their texts is not asked of the whole corpus
    rows = cut_lineage(merged.select(F.col("doc_id").alias("review_id"), F.col("category").alias("label"), "ce_score", F.col("score").alias("cosine_similarity")))
    return cut_lineage(rows.join(docs, "review_id"))


HITS_SQL = f"""{RERANKED},
mg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, doc_id ORDER BY ce_score DESC, beam_id) AS m FROM rr) WHERE m = 1),
lh AS (
  SELECT h.doc_id AS review_id, h.category AS label, h.ce_score, h.score AS cosine_similarity,
         regexp_replace(d.text, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g') AS text
  FROM mg h JOIN documents d ON d.doc_id = h.doc_id
),
ne AS (SELECT * FROM lh WHERE text <> ''),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ce_score DESC, label) AS r FROM ne)
         WHERE r = 1)"""


@register("pseudo_labels", f"""{HITS_SQL},
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ce_score DESC, review_id) AS c FROM best)
           WHERE c <= {CAP})
SELECT review_id, label, round(ce_score, 6) AS ce_score, md5(text) AS text_md5 FROM capped
""")
def pseudo_labels_check(spark, sf_dir):
    p = pseudo_labels(labelled_hits(spark, sf_dir), CAP)
    return p.select("review_id", "label", F.round("ce_score", 6).alias("ce_score"), F.md5("text").alias("text_md5"))


@register("best_label_counts", f"""{HITS_SQL}
SELECT label, count(*) AS n FROM best GROUP BY label
""")
def best_label_counts(spark, sf_dir):
    best = best_per_id(nonempty_text(labelled_hits(spark, sf_dir)), "review_id", "ce_score", "label")
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("dedup_effect", f"""{HITS_SQL}
SELECT (SELECT count(*) FROM ne) AS n_before, (SELECT count(*) FROM best) AS n_after,
       (SELECT count(*) FROM ne) - (SELECT count(*) FROM best) AS n_removed,
       round(100.0 * ((SELECT count(*) FROM ne) - (SELECT count(*) FROM best)) / (SELECT count(*) FROM ne), 1) AS pct_removed
""")
def dedup_effect_check(spark, sf_dir):
    kept = nonempty_text(labelled_hits(spark, sf_dir))
    return dedup_effect(kept, best_per_id(kept, "review_id", "ce_score", "label"))


@register("class_cap_random", f"""{HITS_SQL}
SELECT review_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || review_id::VARCHAR), review_id) AS c FROM best)
WHERE c <= {RANDOM_CAP}
""")
def class_cap_random(spark, sf_dir):
    best = best_per_id(nonempty_text(labelled_hits(spark, sf_dir)), "review_id", "ce_score", "label")
    return random_cap_per_class(best, "label", RANDOM_CAP, "review_id", 42).select("review_id", "label")


@register("text_dedup", """
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY lang, doc_id) AS r FROM documents)
WHERE r = 1
""")
def text_dedup(spark, sf_dir):
    docs = driver.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return dedup_text(docs, "text", ["lang", "doc_id"]).select("doc_id", "lang")


@register("legacy_training_set", f"""{HITS_SQL},
m AS (
  SELECT review_id, text,
         coalesce((SELECT arg_max(b, length(b) * 1000 - i) FROM
                   (SELECT unnest({sql_list(BASE_LABELS)}) AS b, unnest(generate_series(1, {len(BASE_LABELS)})) AS i)
                   WHERE instr(lower(label), b) > 0), lower(label)) AS label
  FROM lh
),
ne2 AS (SELECT * FROM m WHERE text <> ''),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY review_id, label) AS r FROM ne2) WHERE r = 1)
SELECT review_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || review_id::VARCHAR), review_id) AS c FROM dd)
WHERE c <= {RANDOM_CAP}
""")
def legacy_training_check(spark, sf_dir):
    h = labelled_hits(spark, sf_dir).withColumnRenamed("label", "category")
    return legacy_training_set(h, BASE_LABELS, RANDOM_CAP, 42).select("review_id", "label")
