"""op3's model holds every character and every n-gram of every text, and scores each text by the model that does not count it."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import perplexity as Q


def written(text, table):
    """Symbols of a text, runs of spaces as one."""
    out = []
    for ch in text:
        s = int(table[ord(ch)])
        if s:
            while s:
                out.append(s % Q.SYMBOLS)
                s //= Q.SYMBOLS
        elif out and out[-1]:
            out.append(0)
    return out


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney over dictionaries; ``texts`` are lists of symbols."""
    counts = {order: Counter()}
    for s in ([0] * (order - 1) + t for t in texts):
        counts[order].update(tuple(s[i:i + order]) for i in range(len(s) - order + 1))
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    after, taken = {}, {}
    for m, c in counts.items():
        k = [max(1, sum(v == j for v in c.values())) for j in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        taken[m] = [0] + [min(max(j - (j + 1) * y * k[j] / k[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]
        for g, v in c.items():
            after.setdefault(g[:-1], {})[g] = v

    def p(g):
        if not g:
            return 1 / Q.SYMBOLS
        same, d = after.get(g[:-1]), taken[len(g)]
        if not same:
            return p(g[1:])
        total, v = sum(same.values()), same.get(g, 0)
        return (v - d[min(v, 3)]) / total + sum(d[min(x, 3)] for x in same.values()) / total * p(g[1:])
    return p


def rows():
    rnd = random.Random(31)
    pool = ["the", "of", "Sea", "état", "Haus", "x9", "a.", "b#", "你好", "世界", "Жук", "\U0001f600", "ß–"]
    text = lambda: "".join(rnd.choice(pool) + rnd.choice([" ", "\n", "  ", " \t", ""]) for _ in range(rnd.randint(0, 70)))
    out = [(i, text(), rnd.choice(["en", "de", None])) for i in range(45)]
    return out + [(100, None, "en"), (101, "", "de"), (102, out[3][1], out[3][2]), (102, out[3][1], out[3][2]), (None, "alone in its language", "xx"), (103, "* * *", "en")]


@pytest.mark.parametrize("limits", [{}, {"SHARD": 500, "TOGETHER": 200}])
def test_perplexity_is_that_of_the_model_of_all_texts_of_the_other_half(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(Q, k, v)
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    own = Q.languages(df)
    want = []
    for lang in own:
        table = Q.classes(own[lang])
        mine = [(i, t or "") for i, t, g in data if (g or "") == lang]
        fold = lambda t: zlib.crc32(t.encode()) & 1
        models = [plain_model([written(t, table) for _, t in mine if fold(t) == f], Q.LENGTH) for f in (0, 1)]
        for i, t in mine:
            s = [0] * (Q.LENGTH - 1) + written(t, table)
            p = models[1 - fold(t)]
            logs = [math.log2(p(tuple(s[k:k + Q.LENGTH]))) for k in range(len(s) - Q.LENGTH + 1)]
            want.append((str(i), len(t.split()), -sum(logs) / max(1, sum(map(str.isalnum, t)))))
    got = sorted((str(r.doc_id), r.n_words, r.log2_ppl) for r in Q.judge(df).collect())
    want.sort()
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-3)


def test_no_two_characters_are_written_alike():
    points = Q._points()[0]
    plain = np.unique(points)
    for letters in ([], [ord(c) for c in "etaoin"], list(range(0x4E00, 0x4E00 + Q.RANKED))):
        codes = Q.classes(letters)[plain].astype(np.int64)
        assert len(np.unique(codes)) == len(plain)
        first, width = codes % Q.SYMBOLS, 1 + sum(codes >= Q.SYMBOLS ** k for k in (1, 2, 3))
        assert codes.max() < Q.SYMBOLS ** 4 and (codes == 0).sum() == 1
        assert all(len(np.unique(width[first == f])) == 1 for f in np.unique(first))  # the first symbol tells how many there are
        assert all((codes[width > k] // Q.SYMBOLS ** k % Q.SYMBOLS).min() > 0 for k in (1, 2, 3))
    assert (width[np.isin(plain, letters)] <= 2).all()


def test_noise_does_not_vouch_for_itself(spark):
    """Texts of rare characters in no order, each of its own: all their n-grams are new to the model of the other texts."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 6))) for _ in range(200)]
    data = [(i, " ".join(rnd.choice(words) for _ in range(80)), "en") for i in range(200)]
    data += [(1000 + i, " ".join("".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(6)) for _ in range(60)), "en") for i in range(3)]
    judged = Q.judge(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    out = {r.doc_id: (r.log2_ppl, r.kept) for r in judged.collect()}
    assert all(kept == (i < 1000) for i, (_, kept) in out.items())
    assert min(out[i][0] for i in out if i >= 1000) > 14  # about 20,902 characters are as likely as another


def test_kept_rows_come_back_whole_from_many_shards(spark, monkeypatch):
    monkeypatch.setattr(Q, "SHARD", 3000)
    rnd = random.Random(2)
    text = lambda: " ".join(rnd.choice(["an", "er", "the", "on", "in", "re", "st"]) + rnd.choice(["a", "ne", "t"]) for _ in range(90))
    df = spark.createDataFrame([(i, text(), None if i % 7 == 0 else "en", [i, None], {"k": i}) for i in range(60)] + [(99, None, "en", None, None)],
                               "doc_id long, text string, lang string, shard array<int>, rows map<string,int>").withColumn("t", F.lit("2024-02-03 04:05:06.789").cast("timestamp"))
    key = lambda r: (r.doc_id, r.text, r.lang, r.shard, r.rows, r.t)
    kept = {r.doc_id for r in Q.judge(df).where("kept").collect()}
    good = Q.keep_good(df)
    assert good.schema == df.schema and len(kept) > 50
    assert sorted(map(key, good.collect()), key=str) == sorted((key(r) for r in df.collect() if r.doc_id in kept), key=str)
