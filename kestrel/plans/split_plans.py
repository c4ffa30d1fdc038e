"""Checks for splits and samples: L6-L10."""

from pyspark.sql import functions as F

from kestrel.operators.prepare import sample_exact
from kestrel.operators.split import split_report, train_dev_test_split, train_holdout_split, tiny_class_split
from kestrel.plans.registry import register
from kestrel.sources import driver

DEV_RATIO = 0.15 / (1 - 0.2)

RANKED = """
rk AS (
  SELECT doc_id, lang, source,
         row_number() OVER (PARTITION BY {s} ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rnk,
         count(*) OVER (PARTITION BY {s}) AS n
  FROM documents
)"""


def _docs(spark, sf_dir):
    return driver.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


THREE_WAY = f"""
WITH {RANKED.format(s='lang')},
c AS (SELECT *, round(n * 0.2)::BIGINT AS t FROM rk),
c2 AS (SELECT *, round((n - t) * {DEV_RATIO!r})::BIGINT AS d FROM c),
sp AS (SELECT doc_id, lang, CASE WHEN rnk <= t THEN 'test' WHEN rnk <= t + d THEN 'dev' ELSE 'train' END AS split FROM c2)
"""


@register("stratified_split", THREE_WAY + "SELECT doc_id, lang, split FROM sp")
def stratified_split_rows(spark, sf_dir):
    return train_dev_test_split(_docs(spark, sf_dir), "doc_id", "lang").select("doc_id", "lang", "split")


@register("stratified_split_counts", THREE_WAY + "SELECT split, lang, count(*) AS n FROM sp GROUP BY split, lang")
def stratified_split_counts(spark, sf_dir):
    return split_report(train_dev_test_split(_docs(spark, sf_dir), "doc_id", "lang"), "lang")


@register("holdout_split_counts", f"""
WITH {RANKED.format(s='source')},
sp AS (SELECT source, CASE WHEN rnk <= round(n * 0.2) THEN 'holdout' ELSE 'train' END AS split FROM rk)
SELECT split, source, count(*) AS n FROM sp GROUP BY split, source
""")
def holdout_split_counts(spark, sf_dir):
    return split_report(train_holdout_split(_docs(spark, sf_dir), "doc_id", "source", 0.2), "source")


@register("tiny_class_split", f"""
WITH {RANKED.format(s='lang')},
sp AS (SELECT doc_id, lang, CASE WHEN rnk <= (CASE WHEN n > 1 THEN greatest(1, floor(n * 0.1)) ELSE 1 END)
                                 THEN 'val' ELSE 'train' END AS split FROM rk)
SELECT doc_id, lang, split FROM sp
""")
def tiny_class_split_check(spark, sf_dir):
    return tiny_class_split(_docs(spark, sf_dir), "doc_id", "lang", 0.1).select("doc_id", "lang", "split")


@register("seeded_sample", """
SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 100
""")
def seeded_sample(spark, sf_dir):
    """An exact sample of 100 rows is the feature here (reference sample_size)."""
    return sample_exact(_docs(spark, sf_dir), "doc_id", 100, 42).select("doc_id", "lang")
