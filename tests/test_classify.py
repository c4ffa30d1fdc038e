import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import soft_targets as S
from kestrel.operators.bayes import fit_bayes, predict_bayes
from kestrel.operators.classify import fit_classifier, predict

D = 256


def texts(spark, n=240, seed=1):
    rnd = random.Random(seed)
    own = {"a": "red green blue", "b": "one two three", "c": "cat dog green"}
    rows = [(i, " ".join(rnd.choices(own[c].split() * 3 + "the of and one red".split(), k=rnd.randint(1, 12))), c)
            for i in range(n) for c in [rnd.choice("aabc")]]
    return spark.createDataFrame(rows + [(n, "", "a"), (n + 1, None, "b")], "id long, text string, label string").repartition(3)


@pytest.mark.parametrize("reg", [0.01, 0.1])
def test_same_loss_as_the_replicated_fit(spark, reg):
    """The old form, every row once per class with its target as weight, by Spark ML without scaling."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT
    df, labels, eps = S.hashed_terms(texts(spark), "text", D), ["a", "b", "c"], 0.1
    mine = S.fit_grid(df, labels, smoothing=eps, reg_grid=[reg], num_features=D, max_iter=300, tol=1e-12)[0]
    idf = S.inverse_frequencies(df, D)
    as_vector = F.udf(lambda idx: Vectors.sparse(D, sorted((i, idx.count(i) * float(idf[i])) for i in set(idx))), VectorUDT())
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    rep = (df.withColumn("x", as_vector("_idx")).withColumn("_cls", F.explode(F.sequence(F.lit(0), F.lit(2))))
           .withColumn("w", F.when(F.col("_cls") == y, 1 - eps + eps / 3).otherwise(eps / 3)).withColumn("t", F.col("_cls").cast("double")))
    lr = LogisticRegression(featuresCol="x", labelCol="t", weightCol="w", family="multinomial", regParam=reg, maxIter=500, tol=1e-12, standardization=False)
    ref = lr.fit(rep)
    assert mine.loss == pytest.approx(ref.summary.objectiveHistory[-1], abs=1e-6)
    w = ref.coefficientMatrix.toArray() * np.where(np.isfinite(idf), idf, 0)
    seen = np.isfinite(idf)
    assert not mine.weights[:, ~seen].any()
    mine.weights, w = mine.weights[:, seen], w[:, seen]
    assert np.abs((mine.weights - mine.weights.mean(axis=0)) - (w - w.mean(axis=0))).max() < 1e-3


def test_no_row_is_copied_and_one_scan_serves_the_grid(spark, monkeypatch):
    scans, real = [], S.evaluate
    monkeypatch.setattr(S, "evaluate", lambda table, points, *a: scans.append((len(points), table.count())) or real(table, points, *a))
    df = S.hashed_terms(texts(spark), "text", D)
    models = S.fit_grid(df, ["a", "b", "c"], reg_grid=[0.0, 0.1, 1.0], num_features=D, max_iter=5)
    assert scans[0] == (3, df.count()) and len(models) == 3 and models[0].loss < models[2].loss


def test_blocks_of_features_sum_up(spark, monkeypatch):
    df = S.hashed_terms(texts(spark), "text", D)
    whole = S.fit_grid(df, ["a", "b", "c"], reg_grid=[0.1], num_features=D, max_iter=8)[0]
    monkeypatch.setattr(S, "FEATURE_BLOCK", 5)
    cut = S.fit_grid(df.repartition(7), ["a", "b", "c"], reg_grid=[0.1], num_features=D, max_iter=8)[0]
    assert np.allclose(whole.weights, cut.weights, atol=1e-8)


def test_dev_labels_unknown_to_the_model_are_left_out(spark):
    df = texts(spark)
    dev = df.limit(60).unionByName(spark.createDataFrame([(900, "green", "never"), (901, "red", None)], df.schema))
    model, labels, f1 = fit_classifier(df, dev, num_features=D, max_iter=20, reg_grid=(0.0, 0.01))
    assert labels == ["a", "b", "c"] and 0.5 < f1 <= 1
    out = predict(model, labels, df.withColumn("extra", F.lit("x")))
    assert {"id", "text", "label", "extra", "predicted_label", "confidence", "probs"} <= set(out.columns) and out.count() == df.count()
    rows = out.collect()
    assert all(abs(sum(r.probs.values()) - 1) < 1e-9 and r.confidence == max(r.probs.values()) and r.predicted_label == labels[r.predicted_label_id] for r in rows)
    hashed = S.hashed_terms(df, "text", D, "idx")
    again = fit_classifier(hashed, hashed, num_features=D, max_iter=20, reg_grid=(0.0, 0.01), idx_col="idx")[0]
    assert np.allclose(again.weights, model.weights)


def test_bayes_with_unknown_terms_and_no_terms(spark):
    train = spark.createDataFrame([("a", "red red blue"), ("b", "one two"), ("b", ""), (None, "red")], "label string, text string")
    model = fit_bayes(train)
    got = {r.review_id: r for r in predict_bayes(model, spark.createDataFrame([(1, "red"), (2, "unseen words"), (3, None), (4, "one red red")], "review_id long, text string")).collect()}
    p = {c: np.log(np.array([(2 + 1) / (3 + 4), (0 + 1) / (2 + 4)])) for c in ["red"]} | {"one": np.log(np.array([1 / 7, 2 / 6]))}
    prior = np.log(np.array([1 / 3, 2 / 3]))
    for i, z in ((1, prior + p["red"]), (2, prior), (3, prior), (4, prior + p["one"] + 2 * p["red"])):
        e = np.exp(z)
        assert got[i].confidence == pytest.approx((e / e.sum()).max()) and got[i].predicted_label == "ab"[int(z.argmax())]


