"""Checks for gating (P16, P17, J5), the audit (W10, U2) and the classifier."""

from pyspark.sql import functions as F

from kestrel.operators.bayes import fit_bayes, predict_bayes
from kestrel.operators.classify import fit_classifier, predict
from kestrel.operators.diagnose import similarity_audit
from kestrel.operators.evaluate import check_labels, evaluation_report, sample_predictions
from kestrel.operators.expand import gate
from kestrel.operators.split import train_dev_test_split
from kestrel.plans.evaluate_plans import PRED_SQL, centroid_predictions
from kestrel.plans.registry import register
from kestrel.plans.rerank_plans import BASE, first_stage
from kestrel.plans.retrieval_plans import centroid_hits
from kestrel.plans.split_plans import THREE_WAY
from kestrel.plans.sqlparts import WS_CLASS, tokens_sql
from kestrel.session import cut_lineage, shared_dir
from kestrel.sources import driver
from kestrel.sources.io import label_map, write_json

CONF_T, MIN_DOCS = 0.6, 50


@register("gated_docs", PRED_SQL + f""",
sc2 AS (SELECT cq.category, vn.id, round(list_dot_product(vn.e, cq.q), 9) AS score FROM vn CROSS JOIN cq),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS rank FROM sc2),
hh AS (SELECT category, id AS review_id FROM rk2 WHERE rank <= 60 AND score >= 0.1),
fl AS (SELECT h.*, coalesce(p.predicted_label = h.category AND p.confidence >= {CONF_T}, false) AS gated
       FROM hh h LEFT JOIN pred p ON p.id = h.review_id),
ng AS (SELECT category, count_if(gated) AS ng FROM fl GROUP BY category)
SELECT fl.category, fl.review_id, fl.gated FROM fl JOIN ng ON fl.category = ng.category
WHERE fl.gated OR ng.ng < {MIN_DOCS}
""")
def gated_docs(spark, sf_dir):
    hits = centroid_hits(spark, sf_dir).select("category", F.col("id").alias("review_id"))
    pred = centroid_predictions(spark, sf_dir).withColumnRenamed("id", "review_id")
    return gate(hits, pred, CONF_T, MIN_DOCS).select("category", "review_id", "gated")


@register("similarity_audit", f"""{BASE},
ht AS (SELECT h.*, d.text FROM hits h JOIN documents d ON d.doc_id = h.doc_id),
au AS (
  SELECT *, row_number() OVER (PARTITION BY category, beam_id ORDER BY score DESC, doc_id) AS sim_rank,
         len(list_intersect(regexp_split_to_array(lower(query), '{WS_CLASS}+'),
                            regexp_split_to_array(lower(text), '{WS_CLASS}+'))) AS shared_words
  FROM ht
)
SELECT category, beam_id, doc_id, sim_rank::INTEGER AS sim_rank, sim_rank <= 2 AND score > 0.5 AS relevant,
       shared_words::INTEGER AS shared_words, score > 0.7 AND shared_words = 0 AS alert
FROM au
""")
def similarity_audit_check(spark, sf_dir):
    _, hits = first_stage(spark, sf_dir)
    docs = driver.table(spark, sf_dir, "documents").select("doc_id", "text")
    a = similarity_audit(cut_lineage(hits).join(docs, "doc_id"))  # few rows of known size: the corpus's texts are not moved
    return a.select("category", "beam_id", "doc_id", "sim_rank", "relevant", "shared_words", "alert")


def _lang_model(spark, sf_dir):
    docs = driver.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    split = cut_lineage(train_dev_test_split(docs, "doc_id", "label"))
    train = split.where("split = 'train'")
    dev = split.where("split = 'dev'")
    test = split.where("split = 'test'")
    model, labels, _ = fit_classifier(train, dev, reg_grid=(0.0, 0.01), max_iter=30, num_features=1 << 16)
    return model, labels, test


@register("lr_predictions")
def lr_predictions(spark, sf_dir):
    """M6-M8: fit on the train split (language as the class), choose on dev, score test. Rows-only."""
    model, labels, test = _lang_model(spark, sf_dir)
    p = predict(model, labels, test)
    return p.select("doc_id", F.col("label").alias("true_label"), "predicted_label",
                    F.round("confidence", 6).alias("confidence"))


@register("lr_eval_report")
def lr_eval_report(spark, sf_dir):
    """Nested one-row report of the classifier on the test split. Rows-only."""
    model, labels, test = _lang_model(spark, sf_dir)
    p = predict(model, labels, test).withColumn("true_label", F.col("label"))
    rep = evaluation_report(p, "model_r0", "test_split", labels)
    return rep.select("model_path", "total_samples", "round", F.to_json("metrics").alias("metrics"),
                      F.to_json("confusion_matrix").alias("confusion_matrix"))


NB_SQL = THREE_WAY.rstrip() + f""",
tk AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM tk GROUP BY ALL),
tr AS (SELECT sp.lang AS label, term, sum(n) AS n FROM tf JOIN sp ON sp.doc_id = tf.doc_id WHERE split = 'train' AND sp.lang IS NOT NULL GROUP BY ALL),
lab AS (SELECT lang AS label, count(*) AS docs FROM sp WHERE split = 'train' AND lang IS NOT NULL GROUP BY lang),
tot AS (SELECT label, sum(n) AS tot FROM tr GROUP BY label),
voc AS (SELECT DISTINCT term FROM tr),
sz AS (SELECT count(*) AS v, (SELECT sum(docs) FROM lab) AS docs FROM voc),
wt AS (SELECT l.label, v.term, ln((coalesce(tr.n, 0) + 1.0::DOUBLE) / (coalesce(t.tot, 0) + sz.v)::DOUBLE) AS w
       FROM lab l CROSS JOIN voc v CROSS JOIN sz LEFT JOIN tr ON tr.label = l.label AND tr.term = v.term LEFT JOIN tot t ON t.label = l.label),
ll AS (SELECT tf.doc_id, wt.label, sum(tf.n * wt.w) AS z FROM tf JOIN wt ON wt.term = tf.term GROUP BY ALL),
zz AS (SELECT s.doc_id, s.lang AS true_label, l.label, ln(l.docs::DOUBLE / sz.docs) + coalesce(ll.z, 0) AS z
       FROM sp s CROSS JOIN lab l CROSS JOIN sz LEFT JOIN ll ON ll.doc_id = s.doc_id AND ll.label = l.label WHERE s.split = 'test'),
ez AS (SELECT *, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM zz),
pz AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM ez),
pred AS (SELECT doc_id, true_label, label AS predicted_label, p AS confidence
         FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label) AS r FROM pz) WHERE r = 1)"""


def bayes_predictions(spark, sf_dir):
    docs = driver.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    split = cut_lineage(train_dev_test_split(docs, "doc_id", "label"))
    test = split.where("split = 'test'").select("doc_id", "text", F.col("label").alias("true_label"))
    model = fit_bayes(split.where("split = 'train'"))
    return model, predict_bayes(model, test, "doc_id").join(test.select("doc_id", "true_label"), "doc_id")


@register("nb_predictions", NB_SQL + """
SELECT doc_id, true_label, predicted_label, round(confidence, 6) AS confidence FROM pred
""")
def nb_predictions(spark, sf_dir):
    """M6-M8 by counting: language as the class, fitted on the train split, applied to all of the test split."""
    _, p = bayes_predictions(spark, sf_dir)
    return p.select("doc_id", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"))


@register("nb_eval_report", NB_SQL + """,
cmx AS (SELECT true_label, predicted_label, count(*) AS n FROM pred GROUP BY ALL),
labs AS (SELECT true_label AS label FROM cmx WHERE true_label IS NOT NULL UNION SELECT predicted_label FROM cmx),
pc0 AS (SELECT l.label, (SELECT coalesce(sum(n), 0) FROM cmx WHERE true_label = l.label AND predicted_label = l.label) AS tp,
               (SELECT coalesce(sum(n), 0) FROM cmx WHERE true_label = l.label) AS support,
               (SELECT coalesce(sum(n), 0) FROM cmx WHERE predicted_label = l.label) AS n_pred FROM labs l),
pc1 AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc1),
grid AS (SELECT a.label AS t, b.label AS p, coalesce(c.n, 0) AS n FROM lab a CROSS JOIN lab b LEFT JOIN cmx c ON c.true_label = a.label AND c.predicted_label = b.label),
long AS (
  SELECT 'metrics' AS section, 'total_samples' AS label, '' AS item, sum(support)::DOUBLE AS value FROM pc
  UNION ALL SELECT 'metrics', 'round', '', 3.0
  UNION ALL SELECT 'metrics', 'accuracy', '', sum(tp) / sum(support) FROM pc
  UNION ALL SELECT 'metrics', 'f1_macro', '', avg(f1) FROM pc
  UNION ALL SELECT 'metrics', 'f1_weighted', '', sum(f1 * support) / sum(support) FROM pc
  UNION ALL SELECT 'metrics', 'precision_macro', '', avg(precision) FROM pc
  UNION ALL SELECT 'metrics', 'recall_macro', '', avg(recall) FROM pc
  UNION ALL SELECT 'per_class', label, 'precision', precision FROM pc
  UNION ALL SELECT 'per_class', label, 'recall', recall FROM pc
  UNION ALL SELECT 'per_class', label, 'f1', f1 FROM pc
  UNION ALL SELECT 'per_class', label, 'support', support::DOUBLE FROM pc
  UNION ALL SELECT 'confusion', t, p, n::DOUBLE FROM grid)
SELECT section, label, item, round(value::DOUBLE, 6) AS value FROM long
""")
def nb_eval_report(spark, sf_dir):
    """The labels are checked, the nested report is written as JSON, read back and laid out in rows."""
    model, p = bayes_predictions(spark, sf_dir)
    p = cut_lineage(p)
    known = label_map(driver.table(spark, sf_dir, "documents"), "lang").withColumnRenamed("lang", "label")
    check_labels(p.where("true_label IS NOT NULL"), known)
    report = evaluation_report(p, "bayes_r3", "test_split", model.labels)
    path = shared_dir(spark, "report")
    write_json(report, path)
    back = spark.read.schema(report.schema).json(path)
    value = lambda c: F.col(c).cast("double")
    names = report.schema["metrics"].dataType.names
    row = lambda s, a, b, v: F.struct(F.lit(s).alias("section"), a.alias("label"), b.alias("item"), F.round(v, 6).alias("value"))
    total = F.array(row("metrics", F.lit("total_samples"), F.lit(""), value("total_samples")), row("metrics", F.lit("round"), F.lit(""), value("round")),
                    *[row("metrics", F.lit(c), F.lit(""), value(f"metrics.{c}")) for c in names])
    per_class = F.flatten(F.transform(F.map_entries("per_class_metrics"), lambda e: F.array(*[
        row("per_class", e["key"], F.lit(c), e["value"][c].cast("double")) for c in ("precision", "recall", "f1", "support")])))
    labels = F.col("label_names")
    grid = F.flatten(F.transform("confusion_matrix", lambda line, i: F.transform(line, lambda n, j: row(
        "confusion", F.get(labels, i), F.get(labels, j), n.cast("double")))))
    return back.select(F.explode(F.concat(total, per_class, grid)).alias("r")).select("r.*")


@register("prediction_samples", PRED_SQL + """
SELECT id AS review_id, true_label, predicted_label, coalesce(true_label = predicted_label, false) AS correct
FROM pred ORDER BY md5('42:' || id::VARCHAR), id LIMIT 10
""")
def prediction_samples(spark, sf_dir):
    """M9: ten seeded-random nearest-centroid predictions with correctness (the sample is the feature)."""
    p = centroid_predictions(spark, sf_dir).withColumnRenamed("id", "review_id")
    return sample_predictions(p, 10, 42).select("review_id", "true_label", "predicted_label", "correct")
