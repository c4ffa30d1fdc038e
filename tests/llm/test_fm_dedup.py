import random

import numpy as np
from pyspark.sql import functions as F

from kestrel.llm import fm_dedup
from tests.llm import brute


def digest(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str)


def test_rank_and_backward_search():
    rnd = np.random.default_rng(4)
    seq = rnd.integers(0, 37, 3000)
    m = fm_dedup.WaveletMatrix(seq, 37)
    symbol, i = rnd.integers(0, 37, 500), rnd.integers(0, 3001, 500)
    assert m.rank(symbol, i).tolist() == [int((seq[:b] == a).sum()) for a, b in zip(symbol, i)]
    seq = np.append(rnd.integers(1, 4, 400), 0)
    index = fm_dedup.FMIndex(seq, 4, 5)
    live, _ = fm_dedup.matching(index, seq, np.arange(396), 5)
    windows = [tuple(seq[j:j + 5]) for j in range(396)]
    assert live.tolist() == [j for j in range(396) if windows.count(windows[j]) > 1]


def rows(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 3)))
    pool = [[word() for _ in range(rnd.randint(15, 70))] for _ in range(10)]
    gap = lambda: rnd.choice([" ", "\n", " \t ", "  "])
    out = []
    for i in range(60):
        w = sum(([*rnd.choice(pool)] if rnd.random() < 0.5 else [word() for _ in range(rnd.randint(1, 40))] for _ in range(rnd.randint(0, 6))), [])
        out.append((i, "".join(x + gap() for x in w)))
    out += [(100, out[3][1]), (101, out[3][1]), (102, "a " * 90), (103, "b a " * 80), (104, None), (105, ""), (106, "  \n"),
            (None, out[4][1]), (7, out[7][1]), (8, "some other text " * 20), (107, " x  " * 30)]
    rnd.shuffle(out)
    return out


def test_matches_brute_force_with_nulls_ties_and_repeated_rows(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in data], "doc_id long, text string, spans string, copy int").repartition(5)
    assert digest(fm_dedup.remove_repeats(df)) == sorted(brute.fm_rows(data), key=str)


def test_empty_table(spark):
    assert fm_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
