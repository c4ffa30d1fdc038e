"""L6-L10 and A7-A9 on edge fixtures (FIXTURES E3, E4)."""

from pyspark.sql import functions as F

from kestrel.operators.prepare import sample_exact
from kestrel.operators.profile import length_histogram, over_limit
from kestrel.operators.split import split_report, tiny_class_split, train_dev_test_split


def _classes(spark):
    rows = []
    for label, n in [("one", 1), ("two", 2), ("seven", 7), ("hundred", 100)]:
        rows += [(f"{label}-{i}", label) for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string")


def test_three_way_split_sizes_and_disjoint(spark):
    out = train_dev_test_split(_classes(spark), "id", "label").cache()
    assert out.count() == 110 and out.select("id").distinct().count() == 110
    rep = {(r.split, r.label): r.n for r in split_report(out, "label").collect()}
    # per class: test = round(n*0.2), dev = round((n - test) * 0.1875)
    assert rep[("test", "hundred")] == 20 and rep[("dev", "hundred")] == 15 and rep[("train", "hundred")] == 65
    assert rep[("test", "seven")] == 1 and rep[("dev", "seven")] == 1
    assert rep.get(("test", "one"), 0) == 0 and rep[("train", "one")] == 1


def test_rows_without_a_stratum_are_split_too(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 4 > 0 THEN concat('s', id % 4) END AS label")
    out = train_dev_test_split(df, "id", "label")
    assert out.count() == 100
    rep = {(r.split, r.label): r.n for r in split_report(out, "label").collect()}
    assert rep["test", None] == 5


def test_split_is_deterministic(spark):
    a = train_dev_test_split(_classes(spark), "id", "label").orderBy("id").collect()
    b = train_dev_test_split(_classes(spark), "id", "label").orderBy("id").collect()
    assert a == b


def test_tiny_class_split(spark):
    out = tiny_class_split(_classes(spark), "id", "label", 0.15)
    rep = {(r.split, r.label): r.n for r in split_report(out, "label").collect()}
    assert rep[("val", "one")] == 1 and ("train", "one") not in rep
    assert rep[("val", "two")] == 1 and rep[("train", "two")] == 1
    assert rep[("val", "hundred")] == 15


def test_tiny_class_split_fallback(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")], "id string, label string")
    out = tiny_class_split(df, "id", "label", 0.2)
    rep = {r.split: r.n for r in split_report(out, None).collect()}
    assert rep == {"train": 2, "val": 2}


def test_sample_exact(spark):
    df = _classes(spark)
    s = sample_exact(df, "id", 10, 42)
    assert s.count() == 10
    assert sample_exact(df, "id", 1000, 42).count() == 110


def test_histogram_right_closed_and_denominator(spark):
    df = spark.createDataFrame([(x,) for x in [0, 250, 251, 10000, 10001]], "x int")
    h = {r.label: (r.n, r.pct) for r in length_histogram(df, "x").collect()}
    assert h["0-250"] == (1, 20.0)       # 250 in (0,250]; 0 is outside
    assert h["250-500"] == (1, 20.0)     # 251
    assert h["3000+"] == (1, 20.0)       # 10000; 10001 is outside
    assert sum(n for n, _ in h.values()) == 3


def test_over_limit(spark):
    df = spark.createDataFrame([(x,) for x in [100, 300, 600]], "t int")
    o = {r.model: r for r in over_limit(df, "t").collect()}
    m = o["all-MiniLM-L6-v2"]
    assert m.n_over == 2 and abs(m.avg_loss - ((300 - 256) + (600 - 256)) / 2) < 1e-9 and m.max_loss == 344
    assert abs(o["distilbert"].pct_over - 100 / 3) < 1e-9
    assert F is not None
