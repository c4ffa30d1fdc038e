"""Multinomial naive Bayes as a counted table (M6-M8): a classifier that is all joins and sums.

The model is one row per training term with its log weight under every label, and the log share of every label.  A document's score under a label
is that share plus count x weight over its known terms; terms that training never saw are left out.  Postings are pre-aggregated to (document, term,
count) before they meet the model, and a label is a column, so nothing grows with the number of labels but the width of a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import tokens
from kestrel.operators.classify import with_prediction
from kestrel.session import cut_lineage, spread


@dataclass
class BayesModel:
    labels: list[str]
    shares: list[float]  # log share of each label's documents
    terms: DataFrame     # term, weights array<double> in the order of the labels


def term_counts(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """(id columns, term, n)."""
    words = spread(df.select(*id_cols, text_col)).select(*id_cols, F.explode(tokens(text_col)).alias("term"))
    return words.groupBy(*id_cols, "term").agg(F.count(F.lit(1)).alias("n"))


def fit_bayes(train: DataFrame, label_col: str = "label", text_col: str = "text", alpha: float = 1.0) -> BayesModel:
    """Counts, with ``alpha`` added to each term's; rows without a label are left out."""
    train = train.where(F.col(label_col).isNotNull())
    docs = {r[0]: r[1] for r in train.groupBy(label_col).count().collect()}  # a row per label
    labels = sorted(docs)
    counts = term_counts(train, [label_col], text_col)
    wide = cut_lineage(counts.groupBy("term").agg(*[F.sum(F.when(F.col(label_col) == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(labels)]))
    sums = wide.agg(F.count(F.lit(1)), *[F.sum(f"n{k}") for k in range(len(labels))]).first()
    weights = F.array(*[F.log((F.col(f"n{k}") + alpha) / F.lit(float((sums[k + 1] or 0) + alpha * sums[0]))) for k in range(len(labels))])
    total = sum(docs.values())
    return BayesModel(labels, [math.log(docs[x] / total) for x in labels], wide.select("term", weights.alias("weights")))


def predict_bayes(model: BayesModel, df: DataFrame, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """(id, predicted_label_id, predicted_label, confidence, probs); a document without known terms gets the shares."""
    k = range(len(model.labels))
    met = term_counts(df, [id_col], text_col).join(model.terms, "term")
    found = met.select(id_col, *[(F.col("n") * F.get("weights", F.lit(i))).alias(f"z{i}") for i in k])
    base = df.select(id_col, *[F.lit(model.shares[i]).alias(f"z{i}") for i in k])
    z = found.unionByName(base).groupBy(id_col).agg(*[F.sum(f"z{i}").alias(f"z{i}") for i in k])
    top = F.array_max("z")
    e = F.transform("z", lambda x: F.exp(x - F.col("top")))
    p = (z.select(id_col, F.array(*[F.col(f"z{i}") for i in k]).alias("z")).withColumn("top", top).withColumn("e", e)
         .withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
         .select(id_col, F.transform("e", lambda x: x / F.col("sum")).alias("probs")))
    return with_prediction(p, model.labels)
