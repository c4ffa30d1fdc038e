"""Checks of whole pipelines: corpus set-up (G3), threshold search (G8, K2, S10), length profile (G12, F8), diagnosis."""

from pyspark.sql import functions as F

from kestrel.operators.profile import CHAR_EDGES, MODEL_LIMITS, SPECIAL_TOKENS
from kestrel.plans.corpus_cache import corpus_for
from kestrel.plans.diagnose_plans import BOTH, GATE_T, _hits, _pred
from kestrel.plans.registry import register
from kestrel.plans.rounds import diagnose, length_profile, setup_corpus, single_query_report
from kestrel.plans.split_plans import THREE_WAY
from kestrel.plans.sqlparts import retrieve_sql, sparse_index_sql, tokens_sql
from kestrel.session import shared_dir
from kestrel.sources import driver
from kestrel.sources.io import read_search_results, search_results, write_json


def _counts(*parts):
    """Rows (section, item, n) of several one-row tables."""
    out = None
    for section, df in parts:
        row = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("n")) for c in df.columns])).alias("r"))
        d = row.select(F.lit(section).alias("section"), "r.item", F.round("r.n", 6).alias("n"))
        out = d if out is None else out.unionByName(d)
    return out


@register("corpus_setup", THREE_WAY.rstrip() + f""",
train AS (SELECT d.doc_id, d.text FROM documents d JOIN sp ON sp.doc_id = d.doc_id WHERE sp.split = 'train'),
{sparse_index_sql('train')}
SELECT 'split' AS section, split AS item, count(*)::DOUBLE AS n FROM sp GROUP BY split
UNION ALL SELECT 'index', 'docs', (SELECT n FROM nd)::DOUBLE
UNION ALL SELECT 'index', 'terms', count(*)::DOUBLE FROM idf
UNION ALL SELECT 'index', 'postings', count(*)::DOUBLE FROM d_post
""")
def corpus_setup(spark, sf_dir):
    """Stratified three-way split of all documents, then every corpus table over its train part alone."""
    docs = driver.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text", F.col("lang").alias("label"))
    split, corpus = setup_corpus(docs)
    parts = split.groupBy(F.col("split").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("split").alias("section"), "item", "n")
    built = _counts(("index", corpus.n.select(F.col("n").alias("docs"))), ("index", corpus.index.terms.agg(F.count(F.lit(1)).alias("terms"))),
                    ("index", corpus.index.postings.agg(F.count(F.lit(1)).alias("postings"))))
    return parts.unionByName(built)


QUERY, HITS, LEAST = "para mente", 80, 0.05


@register("threshold_search", f"""WITH {sparse_index_sql()}, {retrieve_sql(f"('q', 1, '{QUERY}')", HITS)}
SELECT query, (SELECT count(*) FROM hits WHERE score >= {LEAST}) AS total_above_threshold,
       doc_id AS review_id, round(score, 6) AS cosine_similarity FROM hits WHERE score >= {LEAST}
""")
def threshold_search(spark, sf_dir):
    """One query, top k, similarity threshold; the result document (K2) is written as JSON and read back."""
    corpus = corpus_for(spark, sf_dir)
    kept, _, _ = single_query_report(corpus, spark, QUERY, HITS, LEAST, top_n=10)
    hits = kept.select(F.lit(QUERY).alias("query"), F.col("doc_id").alias("review_id"), F.col("score").alias("cosine_similarity"))
    path = shared_dir(spark, "search")
    write_json(search_results(hits, LEAST), path)
    back = read_search_results(spark, path)
    return back.select("query", "total_above_threshold", "review_id", F.round("cosine_similarity", 6).alias("cosine_similarity"))


@register("length_profile", f"""
WITH d AS (SELECT text, length(text) AS c, len({tokens_sql('text')}) + {SPECIAL_TOKENS} AS t FROM documents)
SELECT 'chars' AS section, 'n' AS item, count(c)::DOUBLE AS n FROM d
UNION ALL SELECT 'chars', 'mean', round(avg(c), 6) FROM d
UNION ALL SELECT 'chars', 'max', max(c)::DOUBLE FROM d
UNION ALL SELECT 'tokens', 'mean', round(avg(t), 6) FROM d
UNION ALL SELECT 'tokens', 'max', max(t)::DOUBLE FROM d
UNION ALL SELECT 'prefixed', 'n_prefixed', count(*) FILTER (starts_with(text, 'Business:'))::DOUBLE FROM d
UNION ALL SELECT 'prefixed', 'n', count(*)::DOUBLE FROM d
UNION ALL SELECT 'prefixed', 'share', round(count(*) FILTER (starts_with(text, 'Business:')) / count(*), 6) FROM d
UNION ALL SELECT 'bins', 'char_total', count(c)::DOUBLE FROM d WHERE c > {float(CHAR_EDGES[0])} AND c <= {float(CHAR_EDGES[-1])}
UNION ALL SELECT 'over', 'limits', {len(MODEL_LIMITS)}.0
""")
def length_profile_check(spark, sf_dir):
    """The length profile of all documents in one call."""
    p = length_profile(driver.table(spark, sf_dir, "documents").select("text"))
    return _counts(("chars", p["chars"].select("n", "mean", "max")), ("tokens", p["tokens"].select("mean", "max")), ("prefixed", p["prefixed"].select("n_prefixed", "n", "share")),
                   ("bins", p["char_bins"].agg(F.sum("n").alias("char_total"))), ("over", p["over_limit"].agg(F.count(F.lit(1)).alias("limits"))))


@register("diagnosis", BOTH + f""",
own AS (SELECT h.category, coalesce(p.predicted_label = h.category AND p.confidence >= {GATE_T}, false) AS ok FROM hh h LEFT JOIN pred p ON p.id = h.review_id),
ret AS (SELECT review_id, category FROM hh WHERE review_id IN (SELECT review_id FROM dup)),
un AS (SELECT DISTINCT r.review_id FROM ret r JOIN pred p ON p.id = r.review_id WHERE NOT (p.predicted_label = r.category AND p.confidence >= {GATE_T})),
hi AS (SELECT id, count(*) FILTER (p >= {GATE_T}) AS k FROM pr WHERE id IN (SELECT review_id FROM dup) GROUP BY id)
SELECT 'summary' AS section, 'total' AS item, count(*)::DOUBLE AS n FROM hh
UNION ALL SELECT 'summary', 'duplicated_ids', count(*)::DOUBLE FROM dup
UNION ALL SELECT 'coverage', 'with_prediction', count(*)::DOUBLE FROM dup WHERE review_id IN (SELECT id FROM pred)
UNION ALL SELECT 'unexpected', 'n', count(*)::DOUBLE FROM un
UNION ALL SELECT 'gate', 'kept', count(*) FILTER (ok)::DOUBLE FROM own
UNION ALL SELECT 'ambiguous', 'multi_high_conf', count(*) FILTER (k > 1)::DOUBLE FROM hi
""")
def diagnosis(spark, sf_dir):
    """G11 in one call, over predictions of two rounds: the last one of every id counts (J5), not the most confident."""
    last = _pred(spark, sf_dir).withColumn("round", F.lit(1))
    older = last.withColumn("round", F.lit(0)).withColumn("predicted_label", F.lit("label_0")).withColumn("confidence", F.lit(2.0))
    d = diagnose(_hits(spark, sf_dir), older.unionByName(last), GATE_T, order_col="round")
    return _counts(("summary", d["summary"].select("total", "duplicated_ids")), ("coverage", d["coverage"].select("with_prediction")),
                   ("unexpected", d["unexpected"].agg(F.count(F.lit(1)).alias("n"))), ("gate", d["gate"].agg(F.sum("kept").alias("kept"))),
                   ("ambiguous", d["multi_high_conf"].select("multi_high_conf")))
