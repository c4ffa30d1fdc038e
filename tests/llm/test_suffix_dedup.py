import random

from kestrel.llm import blocks, hashing
from kestrel.llm.suffix_dedup import remove_repeats
from pyspark.sql import functions as F

from tests.llm import brute


def digest(df):
    out = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(map(tuple, out.collect()), key=str)


def passages(seed=3, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    pool = [" ".join(word() for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(pool) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, "x" * 500), (203, "x" * 350), (204, None), (205, ""),
             (None, rows[5][1]), (7, rows[7][1]), (8, "other text " * 30), (206, "ab" * 400 + "c")]
    rnd.shuffle(rows)
    return rows


def test_matches_brute_force_with_nulls_ties_and_repeated_rows(spark):
    rows = passages()
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, spans string, copy int").repartition(5)
    assert digest(remove_repeats(df)) == sorted(brute.suffix_rows(rows), key=str)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_longer_than_a_stretch_of_positions(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ORDER_BITS", hashing.U(10))
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 8)))
    long = " ".join(word() for _ in range(1500))
    rows = [(1, long), (2, long[700:4000] + "q" * 2000), (3, "other " + long[650:1800]), (4, "short"), (5, long[::-1]), (6, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert digest(remove_repeats(df)) == sorted(brute.suffix_rows(rows), key=str)
