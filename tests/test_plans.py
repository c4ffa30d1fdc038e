"""What the plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators.expand import substring_pairs
from kestrel.operators.pseudo import random_cap_per_class
from kestrel.operators.relational import null_safe_join, top_n
from kestrel.operators.retrieval import topk_exact


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [3, 40, 5000])
def test_top_n_equals_a_global_sort(spark, n):
    df = spark.range(3000).selectExpr("id", "id % 7 AS g", "(id * 7919) % 1013 AS score").withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    got = sorted(map(tuple, top_n(df, n, [F.desc("score"), F.asc("id")], ["g"], ["id"]).select("g", "id", "_rn").collect()), key=str)
    want = []
    for g in [None, *range(1, 7)]:
        rows = sorted(((-r.score, r.id) for r in df.collect() if r.g == g))[:n]
        want += [(g, i, k + 1) for k, (_, i) in enumerate(rows)]
    assert got == sorted(want, key=str)


def test_a_cap_above_the_window_limit_splits_its_groups(spark):
    df = spark.range(100).selectExpr("id", "concat('l', id % 2) AS label")
    text = plan(random_cap_per_class(df, "label", 2000, "id"))
    assert "SinglePartition" not in text and text.count("_part") > 2


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert sorted(map(tuple, null_safe_join(a, b, ["k"]).collect()), key=str) == [("x", 2, 20), (None, 1, 10)]


def test_stored_grams_are_read_by_the_words_that_need_them(spark, tmpdir_path):
    from kestrel.operators.expand import gram_index
    from kestrel.operators.lists import bucketed
    vocab = spark.createDataFrame([(t,) for t in ["banana", "nab", "ananas", "nan", "an", "x", "banane", "canal"]], "term string")
    bucketed(gram_index(vocab), "gram", "term").write.partitionBy("bucket").parquet(f"{tmpdir_path}/g")
    grams = spark.read.parquet(f"{tmpdir_path}/g")
    words = spark.createDataFrame([("an",), ("nana",), ("banan",), ("anan",), ("x",), ("nanb",), ("",)], "word string")
    out = substring_pairs(words, vocab.limit(0), grams)
    terms = [r.term for r in vocab.collect()]
    assert sorted(map(tuple, out.collect())) == sorted((w.word, t) for w in words.collect() if w.word for t in terms if w.word in t)
    assert "PartitionFilters: [bucket" in plan(out) or "PartitionFilters: [isnotnull(bucket" in plan(out)


WORKER = """
import sys
sys.path.insert(0, {repo!r})
from kestrel.session import get_session
from kestrel.operators.encode import embed
spark = get_session("local[2]", shuffle_partitions=2, driver_memory="2g")
df = spark.createDataFrame([(1, "red green red"), (2, None)], "id long, text string")
print("FOUND", embed(df, dim=8).where("id = 1").first().embedding)
"""


def test_embed_runs_on_workers_without_the_package(tmpdir_path):
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", WORKER.format(repo=repo)], cwd=tmpdir_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND [" in out.stdout, out.stderr[-2000:]


def test_substrings_of_all_lengths_in_one_scan(spark, tmpdir_path):
    spark.createDataFrame([("banana",), ("nab",)], "term string").write.parquet(f"{tmpdir_path}/v")
    words = spark.createDataFrame([("an",), ("nan",), ("banana",), ("zz",)], "word string")
    out = substring_pairs(words, spark.read.parquet(f"{tmpdir_path}/v"))
    assert plan(out).count("ReadSchema: struct<term:string>") == 1  # the vocabulary
    assert sorted(map(tuple, out.collect())) == [("an", "banana"), ("banana", "banana"), ("nan", "banana")]


def test_queries_beyond_one_chunk_give_the_same_hits(spark):
    vecs = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "id int, embedding array<double>")
    queries = spark.createDataFrame([(q, [1.0, float(q % 4), 0.5]) for q in range(30)], "qid int, qvec array<double>")
    one = sorted(map(tuple, topk_exact(vecs, queries, 5).collect()))
    assert sorted(map(tuple, topk_exact(vecs, queries, 5, max_query_bytes=100).collect())) == one
