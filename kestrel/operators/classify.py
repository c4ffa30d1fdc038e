"""Classification as data operators.

* ``nearest_centroid``: softmax over cosine to per-class centroids (Arrow
  batch matmul in ``mapInPandas``; the centroid matrix is K x d, as wide as one row of the result).
* ``fit_classifier``: multinomial regression over hashed TF-IDF terms with smoothed targets
  (``soft_targets``).  The model is chosen on the dev set by macro-F1.
* ``predict``: probabilities -> label, confidence and a label->prob map.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.vectors import argmax
from kestrel.operators.soft_targets import TextModel, fit_grid, hashed_terms, probabilities
from kestrel.session import cut_lineage, spread

CENTROID_BLOCK = 1024  # classes scored against a batch at a time


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, temperature: float = 10.0, *,
                     id_col: str = "id", vec_col: str = "embedding", label_col: str = "category",
                     cvec_col: str = "qvec") -> DataFrame:
    """Predictions (id, predicted_label, confidence, probs) from unit vectors and unit centroids."""
    # every result row holds a probability per class, so K centroids are a few rows' worth of data
    cp = centroids.select(label_col, cvec_col).toPandas()
    cp = cp.sort_values(label_col, kind="stable").reset_index(drop=True)
    labels = list(cp[label_col])
    cmat = np.stack([np.asarray(v, dtype=np.float64) for v in cp[cvec_col]])

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
            z = np.concatenate([np.round(x @ cmat[lo:lo + CENTROID_BLOCK].T, 12)
                                for lo in range(0, len(cmat), CENTROID_BLOCK)], axis=1) * temperature
            z = z - z.max(axis=1, keepdims=True)
            e = np.exp(z)
            p = e / e.sum(axis=1, keepdims=True)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "probs": list(p)})

    schema = T.StructType([vectors.schema[id_col], T.StructField("probs", T.ArrayType(T.DoubleType()))])
    out = spread(vectors.select(id_col, vec_col)).mapInPandas(run, schema)
    return with_prediction(out, labels)


def with_prediction(df: DataFrame, labels: Sequence[str], probs_col: str = "probs") -> DataFrame:
    """argmax label (first on ties), max probability and label -> prob map."""
    lab = F.array(*[F.lit(x) for x in labels])
    idx = argmax(probs_col)
    return (df.withColumn("predicted_label_id", idx)
            .withColumn("predicted_label", F.element_at(lab, idx + 1))
            .withColumn("confidence", F.array_max(probs_col))
            .withColumn("probs", F.map_from_arrays(lab, F.col(probs_col))))


def fit_classifier(train: DataFrame, dev: DataFrame, *, text_col: str = "text", label_col: str = "label",
                   smoothing: float = 0.1, reg_grid: Sequence[float] = (0.0, 0.01, 0.1),
                   num_features: int = 1 << 18, max_iter: int = 50, idx_col: str | None = None):
    """M6: fit on pseudo labels, choose by macro-F1 on the dev set. Returns (model, labels, dev_f1).

    ``idx_col``: hashed terms that both tables already carry (``hashed_terms``); else they are made from the text, once.
    """
    from kestrel.operators.evaluate import metrics

    labels = sorted(r[0] for r in train.select(label_col).where(F.col(label_col).isNotNull()).distinct().collect())  # K labels, alphabetical
    dev = dev.where(F.col(label_col).isin(labels))  # P14: only labels the model can predict

    def hashed(df):
        d = df.withColumn("_idx", F.col(idx_col)) if idx_col else hashed_terms(df, text_col, num_features)
        return d.select(F.col(label_col).alias("true_label"), "_idx")

    models = fit_grid(hashed(train), labels, "true_label", smoothing=smoothing, reg_grid=reg_grid, num_features=num_features, max_iter=max_iter)
    held = cut_lineage(hashed(dev))
    best = None
    for model in models:
        f1 = metrics(with_prediction(probabilities(held, model), labels, "_p")).first()["f1_macro"] or 0.0
        if best is None or f1 > best[2]:
            best = (model, labels, f1)
    return best


def predict(model: TextModel, labels: Sequence[str], df: DataFrame, text_col: str = "text",
            idx_col: str | None = None) -> DataFrame:
    """M7/M8: add predicted_label_id, predicted_label, confidence, probs (``idx_col`` as in ``fit_classifier``; it is used up)."""
    d = df.withColumnRenamed(idx_col, "_idx") if idx_col else hashed_terms(df, text_col, model.weights.shape[1])
    return with_prediction(probabilities(d, model), labels, "_p").drop("_p")
