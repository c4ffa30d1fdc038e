"""Checks of operators on inputs that the other checks do not hold: null keys, caps above 1,000, repeated
predictions, ties, inner punctuation, many micro-batches, and round trips through files."""

from pyspark.sql import functions as F

from kestrel.functions.text import tokens, truncate
from kestrel.operators.diagnose import duplicate_detail, gate_effect
from kestrel.operators.evaluate import attach_predictions, by_confidence, calibration_report, confusion_matrix, label_slice, stage_counts
from kestrel.operators.prepare import null_label_count, prepare_reviews, single_target, value_counts
from kestrel.operators.encode import embed
from kestrel.operators.pseudo import cap_per_class, legacy_training_split, random_cap_per_class
from kestrel.operators.retrieval import build_ivf, read_ivf, topk_exact, topk_ivf, write_ivf
from kestrel.operators.split import split_report, train_dev_test_split, unlabelled_count
from kestrel.operators.tfidf import tfidf
from kestrel.plans.diagnose_plans import BOTH, GATE_T, _hits, _pred
from kestrel.plans.evaluate_plans import CAL_SQL, PRED_SQL, centroid_predictions
from kestrel.plans.io_plans import DOC_SCHEMA
from kestrel.plans.prepare_plans import BIZ_CTE, REVIEWS_CTE, TARGETS
from kestrel.plans.corpus_cache import corpus_for
from kestrel.plans.expand_plans import NUM_BEAMS, ROUND0_BEAMS, SEEDS
from kestrel.plans.pseudo_plans import BASE_LABELS, HITS_SQL, labelled_hits
from kestrel.plans.registry import register
from kestrel.plans.rerank_plans import BASE, BEAM_QUERIES, CE_T, K1, K2, beam_query_df, first_stage
from kestrel.plans.retrieval_plans import K, T
from kestrel.plans.rounds import RoundConfig, run_round, save_round, write_round_document
from kestrel.plans.sqlparts import bm25_sql, clean_sql, retrieve_sql, sparse_index_sql, sql_list, tokens_sql, topk_hits_cte
from kestrel.plans.split_plans import DEV_RATIO
from kestrel.plans.tfidf_plans import tfidf_sql_ctes
from kestrel.session import cut_lineage, shared_dir
from kestrel.sources import driver
from kestrel.sources.io import label_map, load_table, read_csv_table, read_json_table, search_results, write_csv, write_json
from kestrel.streaming.ingest import ingest

BIG_CAP = 2000
MICRO_BATCHES = 104


def _docs(spark, sf_dir, *cols):
    return driver.table(spark, sf_dir, "documents").select("doc_id", *cols)


# --- sources, sinks, streams -------------------------------------------------

@register("stream_row_count", "SELECT count(*) AS n FROM documents")
def stream_row_count(spark, sf_dir):
    """The returned count, over more micro-batches than the query progress remembers."""
    src = shared_dir(spark, "json-many")
    driver.table(spark, sf_dir, "documents").repartition(MICRO_BATCHES).write.json(src)
    n = ingest(spark, src, DOC_SCHEMA, shared_dir(spark, "many-sink"), shared_dir(spark, "many-ckpt"))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@register("json_first_records", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def json_first_records(spark, sf_dir):
    """The first records of a file, in file order (the limit is the feature)."""
    src = shared_dir(spark, "json-ordered")
    write_json(driver.table(spark, sf_dir, "documents").coalesce(1).sortWithinPartitions("doc_id"), src)
    return load_table(spark, {"review": src}, "review", DOC_SCHEMA, 50).select("doc_id", "lang")


@register("json_all_records", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def json_all_records(spark, sf_dir):
    src = shared_dir(spark, "json-by-lang")
    write_json(driver.table(spark, sf_dir, "documents"), src)
    return read_json_table(spark, src, DOC_SCHEMA).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@register("csv_roundtrip", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def csv_roundtrip(spark, sf_dir):
    """Quoted multi-line text survives a CSV file."""
    path = shared_dir(spark, "csv-docs")
    write_csv(_docs(spark, sf_dir, "text", "lang"), path)
    return read_csv_table(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text_md5"), "lang")


@register("search_result_order", f"""{BASE},
kept AS (SELECT category || '|' || beam_id::VARCHAR AS query, doc_id AS review_id, round(score, 1) AS s FROM hits),
q AS (SELECT DISTINCT query FROM kept UNION ALL SELECT 'nothing'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, review_id) - 1 AS place FROM kept WHERE s >= 0.2)
SELECT q.query, o.place::INTEGER AS place, o.review_id FROM q LEFT JOIN ordered o ON q.query = o.query
""")
def search_result_order(spark, sf_dir):
    """K2: the nested reviews in order, scores rounded so that ties abound, and a query without hits."""
    _, hits = first_stage(spark, sf_dir)
    h = hits.select(F.concat_ws("|", "category", F.col("beam_id").cast("string")).alias("query"), F.col("doc_id").alias("review_id"),
                    F.round("score", 1).alias("cosine_similarity"))
    queries = h.select("query").distinct().unionByName(spark.range(1).select(F.lit("nothing").alias("query")))
    res = search_results(h, 0.2, queries=queries)
    return res.select("query", F.posexplode_outer("reviews").alias("place", "r")).select("query", "place", F.col("r.review_id").alias("review_id"))


# --- text, TF-IDF, splits, caps ----------------------------------------------

PUNCTUATED = "replace(replace(replace(text, '. ', '...'), ' of ', ',(of)'), ' the ', ' the''s/don''t ')"


@register("tokens_inner_punctuation", f"""
SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS words_md5
FROM (SELECT doc_id, {tokens_sql(PUNCTUATED)} AS t FROM documents)
""")
def tokens_inner_punctuation(spark, sf_dir):
    """F9 on all documents, with marks put between their words."""
    t = tokens(F.expr("replace(replace(replace(text, '. ', '...'), ' of ', ',(of)'), ' the ', \" the's/don't \")"))
    return _docs(spark, sf_dir, t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("words_md5"))


NULL_LANG = "CASE WHEN lang <> 'fr' THEN lang END"


@register("tfidf_null_group", f"""
WITH {tfidf_sql_ctes(f"docs AS (SELECT coalesce({NULL_LANG}, '-') AS grp, doc_id, text FROM documents)", 1500)},
top AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, term) AS rank FROM sc)
SELECT nullif(grp, '-') AS lang, term, df, cf, round(score, 6) AS score FROM top WHERE rank <= 1200
""")
def tfidf_null_group(spark, sf_dir):
    """X1, L4 with documents that have no group, and more terms than one window keeps."""
    docs = _docs(spark, sf_dir, "text", F.expr(NULL_LANG).alias("lang"))
    top = tfidf(docs, ["lang"], max_features=1500).top(1200)
    return top.select("lang", "term", "df", "cf", F.round("score", 6).alias("score"))


@register("split_null_stratum", f"""
WITH rk AS (SELECT {NULL_LANG} AS lang, row_number() OVER (PARTITION BY {NULL_LANG} ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rnk,
                   count(*) OVER (PARTITION BY {NULL_LANG}) AS n FROM documents),
c AS (SELECT *, round(n * 0.2)::BIGINT AS t FROM rk),
d AS (SELECT *, round((n - t) * {DEV_RATIO!r})::BIGINT AS d FROM c)
SELECT CASE WHEN rnk <= t THEN 'test' WHEN rnk <= t + d THEN 'dev' ELSE 'train' END AS split, lang, count(*) AS n FROM d GROUP BY ALL
""")
def split_null_stratum(spark, sf_dir):
    docs = _docs(spark, sf_dir, F.expr(NULL_LANG).alias("lang"))
    return split_report(train_dev_test_split(docs, "doc_id", "lang"), "lang")


@register("unlabelled_rows", f"SELECT count(*) AS n_unlabelled FROM documents WHERE {NULL_LANG} IS NULL")
def unlabelled_rows(spark, sf_dir):
    return unlabelled_count(_docs(spark, sf_dir, F.expr(NULL_LANG).alias("lang")), "lang")


@register("class_cap_2000", f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents)
WHERE r <= {BIG_CAP}
""")
def class_cap_2000(spark, sf_dir):
    """W2 above the size that a window limit covers."""
    return cap_per_class(_docs(spark, sf_dir, "lang", "n_chars"), "lang", BIG_CAP, "n_chars", "doc_id").select("doc_id", "lang")


@register("random_cap_2000", f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS r FROM documents)
WHERE r <= {BIG_CAP}
""")
def random_cap_2000(spark, sf_dir):
    """W3 above that size."""
    return random_cap_per_class(_docs(spark, sf_dir, "lang"), "lang", BIG_CAP, "doc_id", 42).select("doc_id", "lang")


# --- preparation -------------------------------------------------------------

@register("prepared_by_stars", f"""
WITH {REVIEWS_CTE}, c AS (SELECT review_id, stars, useful, {clean_sql('text')} AS t FROM r)
SELECT review_id, left(t, 20) AS head, length(t)::INTEGER AS text_length FROM c
WHERE length(t) BETWEEN 25 AND 5000 AND stars BETWEEN 0.5 AND 1.5 AND useful >= 1
""")
def prepared_by_stars(spark, sf_dir):
    """P4 (both bounds), P5, P6, F7."""
    out = prepare_reviews(driver.reviews(spark, sf_dir), min_len=25, max_len=5000, min_stars=0.5, max_stars=1.5, min_useful=1)
    return out.select("review_id", truncate("text", 20).alias("head"), "text_length")


CATEGORIES_SQL = "concat_ws(', ', p_type, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2])"
assert CATEGORIES_SQL in BIZ_CTE


@register("few_categories", f"""
WITH {BIZ_CTE.replace(CATEGORIES_SQL, f"CASE WHEN p_partkey % 2 = 0 THEN regexp_replace({CATEGORIES_SQL}, ',[^,]*$', '') ELSE {CATEGORIES_SQL} END")}
SELECT business_id, category_count FROM single WHERE category_count <= 2
""")
def few_categories(spark, sf_dir):
    """P10: every other business has its last category taken off."""
    fewer = F.when(F.col("business_id") % 2 == 0, F.regexp_replace("categories", ",[^,]*$", "")).otherwise(F.col("categories"))
    return (single_target(driver.businesses(spark, sf_dir).withColumn("categories", fewer), TARGETS, max_categories=2)
            .select("business_id", "category_count"))


@register("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    """A2."""
    return value_counts(_docs(spark, sf_dir, "source"), "source")


@register("null_labels", "SELECT count(*) AS null_labels FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def null_labels(spark, sf_dir):
    """A3."""
    return null_label_count(_docs(spark, sf_dir).join(driver.table(spark, sf_dir, "labels"), "doc_id", "left"), "quality")


@register("label_ids", "SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS label_id FROM (SELECT DISTINCT lang FROM documents)")
def label_ids(spark, sf_dir):
    """K9, J11."""
    return label_map(_docs(spark, sf_dir, "lang"), "lang")


# --- evaluation and diagnosis ------------------------------------------------

@register("label_slice", PRED_SQL + """
SELECT id, predicted_label FROM pred WHERE true_label = 'label_3' ORDER BY round(confidence, 6) DESC, id LIMIT 20
""")
def label_slice_check(spark, sf_dir):
    """The most confident rows of a true label (the slice is the feature)."""
    p = centroid_predictions(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))
    return label_slice(p, "label_3", 20, id_col="id").select("id", "predicted_label")


@register("confidence_order", PRED_SQL + """
SELECT id, (row_number() OVER (ORDER BY round(confidence, 6) DESC, id) - 1)::BIGINT AS place FROM pred
""")
def confidence_order(spark, sf_dir):
    """Places in the order, numbered by partition so that the order itself is kept."""
    p = centroid_predictions(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))
    ordered = cut_lineage(by_confidence(p, id_col="id").coalesce(1).withColumn("place", F.monotonically_increasing_id()))
    return ordered.select("id", "place")


@register("calibration_pipeline", CAL_SQL + """
SELECT predicted_label, bin, round(avg(correct), 6) AS accuracy, count(*) AS n FROM bb GROUP BY predicted_label, bin
""")
def calibration_pipeline(spark, sf_dir):
    """Predictions attached to all rows, ordered, flagged and binned by predicted label."""
    p = centroid_predictions(spark, sf_dir)
    rows = p.select("id", "true_label")
    out = calibration_report(rows, p.drop("true_label"), id_col="id")["bins_by_label"]
    return out.select("predicted_label", "bin", F.round("accuracy", 6).alias("accuracy"), "n")


@register("attached_predictions", PRED_SQL + """
SELECT d.doc_id, p.predicted_label, coalesce(p.predicted_label = 'label_' || (d.doc_id % 10)::VARCHAR, false) AS correct
FROM documents d LEFT JOIN pred p ON p.id = d.doc_id
""")
def attached_predictions(spark, sf_dir):
    """Every row keeps its place; one without a prediction is wrong."""
    from kestrel.operators.evaluate import correct_flag
    rows = _docs(spark, sf_dir, F.concat(F.lit("label_"), (F.col("doc_id") % 10).cast("string")).alias("true_label"))
    p = centroid_predictions(spark, sf_dir).select(F.col("id").alias("doc_id"), "predicted_label")
    return attach_predictions(rows, p, "doc_id").select("doc_id", "predicted_label", correct_flag().alias("correct"))


@register("confusion_wide", PRED_SQL + """
SELECT true_label, """ + ", ".join(f"count_if(predicted_label = 'label_{k}') AS label_{k}" for k in range(10)) + """
FROM pred GROUP BY true_label
""")
def confusion_wide(spark, sf_dir):
    """A16, wide form."""
    return confusion_matrix(centroid_predictions(spark, sf_dir), [f"label_{k}" for k in range(10)])


REPEATED = """,
rep AS (
  SELECT id, predicted_label, confidence, 0 AS row_no FROM pred
  UNION ALL SELECT id, 'label_1', 0.99, 1 FROM pred WHERE id % 3 = 0
  UNION ALL SELECT id, 'label_2', 0.75, 2 FROM pred WHERE id % 6 = 0),
lastp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) AS r FROM rep) WHERE r = 1)"""


def _repeated(spark, sf_dir):
    """Predictions in which a third of the ids are listed again, later and otherwise."""
    p = _pred(spark, sf_dir).select("review_id", "predicted_label", "confidence").withColumn("row_no", F.lit(0))
    again = p.where("review_id % 3 = 0").select("review_id", F.lit("label_1").alias("predicted_label"), F.lit(0.99).alias("confidence"), F.lit(1).alias("row_no"))
    third = p.where("review_id % 6 = 0").select("review_id", F.lit("label_2").alias("predicted_label"), F.lit(0.75).alias("confidence"), F.lit(2).alias("row_no"))
    return p.unionByName(again).unionByName(third)


@register("gate_effect_duplicates", BOTH + REPEATED + f""",
g AS (SELECT h.category, coalesce(p.predicted_label = h.category AND p.confidence >= {GATE_T}, false) AS pass
      FROM hh h LEFT JOIN lastp p ON p.id = h.review_id)
SELECT category, count(*) AS retrieved, count_if(pass) AS kept FROM g GROUP BY category
""")
def gate_effect_duplicates(spark, sf_dir):
    """The last prediction of an id counts, once."""
    return gate_effect(_hits(spark, sf_dir), _repeated(spark, sf_dir), GATE_T, order_col="row_no").select("category", "retrieved", "kept")


@register("duplicate_detail", BOTH + REPEATED + f""",
ret AS (SELECT review_id, count(*) AS n, list_sort(list(DISTINCT category)) AS retrieved FROM hh
        WHERE review_id IN (SELECT review_id FROM dup) GROUP BY review_id)
SELECT r.review_id, r.n, array_to_string(r.retrieved, ',') AS retrieved, p.predicted_label,
       array_to_string(list_filter(r.retrieved, lambda c: coalesce(c = p.predicted_label AND p.confidence >= {GATE_T}, false)), ',') AS passing
FROM ret r LEFT JOIN lastp p ON p.id = r.review_id
""")
def duplicate_detail_check(spark, sf_dir):
    """G11."""
    d = duplicate_detail(_hits(spark, sf_dir), _repeated(spark, sf_dir), GATE_T, order_col="row_no")
    return d.select("review_id", "n", F.array_join("retrieved", ",").alias("retrieved"), "predicted_label", F.array_join("passing", ",").alias("passing"))


@register("stage_counts", BOTH + f"""
SELECT category, 'retrieved' AS stage, count(*) AS n FROM hh GROUP BY category
UNION ALL SELECT category, 'strong', count(*) FROM hh WHERE ce_score >= 0.5 GROUP BY category
""")
def stage_counts_check(spark, sf_dir):
    """A26."""
    hits = cut_lineage(_hits(spark, sf_dir))
    return stage_counts(retrieved=hits, strong=hits.where("ce_score >= 0.5")).select("category", "stage", "n")


@register("ivf_all_lists", f"""
WITH {topk_hits_cte(K, -2.0)}
SELECT category, id, round(score, 6) AS score, rank::INTEGER AS rank FROM hits
""")
def ivf_all_lists(spark, sf_dir):
    """L2, K5: a written index, read back and probed in every list, is exact."""
    vecs = driver.vectors(spark, sf_dir)
    path = shared_dir(spark, "ivf")
    write_ivf(*build_ivf(vecs, 8), path)
    assigned, cents = read_ivf(spark, path)
    hits = topk_ivf(assigned, cents, driver.centroid_queries(vecs), K, nprobe=8, key_cols=["category"])
    return hits.select("category", "id", F.round("score", 6).alias("score"), "rank")


# --- encoder, legacy training set, round documents ----------------------------

DIM, TOP = 64, 20
_QUERIES = ", ".join(f"('{c}', {b}, '{q}')" for c, b, q in BEAM_QUERIES)


def _hashed_sql(p: str, src: str, key: str, text: str) -> str:
    """CTE ``{p}v(key, b, x)``: unit vectors of hashed word counts, their non-zero places."""
    return f"""
{p}t AS (SELECT {key} AS key, unnest({tokens_sql(text)}) AS term FROM {src}),
{p}c AS (SELECT key, ('0x' || left(md5(term), 6))::BIGINT % {DIM} AS b, count(*) AS n FROM {p}t GROUP BY ALL),
{p}v AS (SELECT key, b, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS x FROM {p}c)"""


@register("hash_embed_topk", f"""
WITH qs AS (SELECT category || '|' || beam_id::VARCHAR AS qid, query FROM (VALUES {_QUERIES}) AS v(category, beam_id, query)),
{_hashed_sql('d', 'documents', 'doc_id', 'text')}, {_hashed_sql('q', 'qs', 'qid', 'query')},
hit AS (SELECT q.key AS qid, d.key AS doc_id, sum(q.x * d.x) AS s FROM qv q JOIN dv d ON q.b = d.b GROUP BY ALL),
every AS (SELECT qs.qid, documents.doc_id, round(coalesce(hit.s, 0.0), 9) AS score
          FROM qs CROSS JOIN documents LEFT JOIN hit ON hit.qid = qs.qid AND hit.doc_id = documents.doc_id)
SELECT qid, doc_id, round(score, 6) AS score, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM every) WHERE rank <= {TOP}
""")
def hash_embed_topk(spark, sf_dir):
    """M1, M2, L1: documents and queries through the default encoder, exact top-k."""
    docs = embed(_docs(spark, sf_dir, "text"), dim=DIM).select("doc_id", "embedding")
    queries = embed(beam_query_df(spark).withColumn("qid", F.concat_ws("|", "category", F.col("beam_id").cast("string"))), "query", dim=DIM, out="qvec")
    hits = topk_exact(docs, queries, TOP, id_col="doc_id", key_cols=["qid"])
    return hits.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("legacy_training_split", f"""{HITS_SQL},
m AS (SELECT review_id, text, coalesce((SELECT arg_max(b, length(b) * 1000 - i) FROM
        (SELECT unnest({sql_list(BASE_LABELS)}) AS b, unnest(generate_series(1, {len(BASE_LABELS)})) AS i) WHERE instr(lower(label), b) > 0), lower(label)) AS label FROM lh),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY review_id, label) AS r FROM m WHERE text <> '') WHERE r = 1),
rq AS (SELECT review_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || review_id::VARCHAR), review_id) AS rnk,
              count(*) OVER (PARTITION BY label) AS n, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS label_id FROM dd)
SELECT review_id, label, label_id, CASE WHEN rnk <= (CASE WHEN n > 1 THEN greatest(1, floor(n * 0.2)) ELSE 1 END) THEN 'val' ELSE 'train' END AS split FROM rq
""")
def legacy_training_split_check(spark, sf_dir):
    """Label ids (J11) and the split (L9) at its end, under the default cap of 2,000."""
    h = labelled_hits(spark, sf_dir).withColumnRenamed("label", "category")
    return legacy_training_split(h, BASE_LABELS, BIG_CAP, 0.2).select("review_id", "label", "label_id", "split")


_SEEDS = ", ".join(f"('{c}', {b}, '{q}')" for c, b, q in ROUND0_BEAMS)


@register("round0_document", f"""WITH {sparse_index_sql()}, {retrieve_sql(_SEEDS, K1)}, {bm25_sql()},
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ce_score DESC, rank) AS ce_rank FROM ce)
       WHERE ce_rank <= {K2} AND ce_score >= {CE_T}),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, doc_id ORDER BY ce_score DESC, beam_id) AS r FROM rr) WHERE r = 1),
c AS (SELECT category, count(*) AS n FROM u GROUP BY category),
o AS (SELECT category, doc_id, (row_number() OVER (PARTITION BY category ORDER BY ce_score DESC, doc_id) - 1)::INTEGER AS place FROM u),
cats AS (SELECT DISTINCT category FROM qv)
SELECT cats.category, (SELECT count(*) FROM documents) AS total_reviews_corpus, coalesce(c.n, 0) AS total_after_merging,
       coalesce(c.n, 0) AS filtered_doc_count, coalesce(c.n, 0) AS total_documents, false AS used_model_filtering, 3::BIGINT AS n_beams, o.place, o.doc_id AS review_id
FROM cats LEFT JOIN c ON c.category = cats.category LEFT JOIN o ON o.category = cats.category
""")
def round0_document(spark, sf_dir):
    """The document of a first round without training, stored by round and category as JSON and read back."""
    corpus = corpus_for(spark, sf_dir)
    cfg = RoundConfig(SEEDS, NUM_BEAMS, K1, K2, CE_T, train_model=False)
    res = save_round(run_round(spark, corpus, cfg, 0), shared_dir(spark, "rounds"))
    doc = write_round_document(res, cfg, shared_dir(spark, "document"), corpus.docs)
    return (doc.select("category", "total_reviews_corpus", "total_after_merging", "filtered_doc_count",
                    F.col("tfidf_analysis.total_documents").alias("total_documents"), "used_model_filtering",
                    F.size("beams").cast("long").alias("n_beams"), F.posexplode_outer("reviews").alias("place", "r"))
            .select("*", F.col("r.review_id").alias("review_id")).drop("r"))
