"""Words split as whole Arrow batches equal those of ``tokens`` (F9), text by text."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from kestrel.functions import arrow_words as A
from kestrel.functions.text import SINGLE_MARKS, SPACES, tokens
from kestrel.operators.tfidf import raw_counts

ODD = ["don't", "can't.", "n't", "'tis", "johns'", "john's.", "''a''.", "he'll", "x'd's", "l'homme", "cannot", "wanna.", "wannabe", "a--b", "a---b", "a----", "-a", "a-b", "a.b", "a..b",
       "a...", ".a", ".", "..", "1,2", "a,2", "a,b", "a:5x", "x2", "Ünï", "ÉTAT", "straße", "İstanbul", "Ⱥa", "ŉa", "ª", "²a", "½", "µm", "漢字", "привет", "éa", "“q”", "it’s",
       "a‑b", "﻿a", "a\x00b", "\x7fa", "a\x1cb", "\U0001f600", "_a", "a_b", "don't'", "o'n't", "'", "''", "a'.", "a.'", "Σίσυφος", "a​b", "a⁠b"]


def texts(n=1500):
    rnd = random.Random(11)
    marks = list(SINGLE_MARKS + SPACES) + list("'.-,:09 ntsé") + ["\n", " ", " "]
    out = [None, "", " ", "a", "a\n", *ODD]
    for i in range(n):
        pool = ODD if i % 3 == 0 else ["the", "Sea", "état.", "Haus,", "don't", "a..", "x9", "'s", "--", "1,5", "ok."]
        out.append("".join(rnd.choice(pool) + "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 3))) for _ in range(rnd.randint(0, 25))))
    return out


def test_words_of_a_batch_equal_tokens(spark, monkeypatch):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "doc_id long, text string")
    low = F.lower("text")
    rows = df.select("doc_id", A.plain(low).alias("plain"), F.concat(low, F.lit(" ")).alias("low"), tokens("text").alias("want")).orderBy("doc_id").collect()
    mine = [r for r in rows if r.plain or r.plain is None]
    assert 500 < len(mine) < len(rows) - 50
    for piece in (A.PIECE, 64):  # texts that lie in one piece, and in many
        monkeypatch.setattr(A, "PIECE", piece)
        held = pa.array([None, "x ", *(r.low for r in mine)])[2:]  # a slice: its offsets do not begin at 0
        found, lens = A.words(held)
        found, at = found.to_pylist(), 0
        for r, n in zip(mine, lens):
            assert found[at:at + n] == (r.want or []), r
            at += n
        assert at == len(found)


def test_counts_of_all_texts_equal_those_of_tokens(spark):
    df = spark.createDataFrame([(i // 2 if i % 7 == 0 else 10_000 + i, t) for i, t in enumerate(texts(400))], "doc_id long, text string").repartition(3)
    want = Counter((r.doc_id, r.token) for r in df.select("doc_id", F.explode(tokens("text")).alias("token")).collect())
    assert {(r.doc_id, r.token): r.tf for r in raw_counts(df).collect()} == dict(want)


def test_no_text_and_no_table(spark):
    assert [len(x) for x in A.words(pa.array([], pa.string()))] == [0, 0]
    assert A.words(pa.array([None, "", None], pa.string()))[1].tolist() == [0, 0, 0]
    assert raw_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plain_texts_are_not_split_by_regular_expressions(spark):
    df = spark.createDataFrame([(1, "The sea, don't go.")], "doc_id long, text string")
    assert df.select(A.plain(F.lower("text"))).first()[0] is True
    assert sorted((r.token, r.tf) for r in raw_counts(df).collect()) == [("do", 1), ("go", 1), ("sea", 1), ("the", 1)]
