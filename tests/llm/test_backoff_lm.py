import math
import random
import zlib
from collections import Counter

import numpy as np

from kestrel.llm import backoff_lm as L


def split(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return low.split() + [None]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def model(rows, order, head_share, arc_share):
    """The same smoothing by plain recursion over dictionaries."""
    train = [split(t) for i, t in rows if not is_held(i)]
    uni = Counter(w for t in train for w in t)
    total, v = sum(uni.values()), len(uni)
    head = {w for w, n in uni.items() if n >= head_share * total}
    grams = {1: {(w,): uni[w] for w in head} | {("<s>",): len(train)}}
    for n in range(2, order + 1):
        c = Counter()
        for t in train:
            s = ["<s>", *t]
            for k in range(len(s) - n + 1):
                g = tuple(s[k:k + n])
                if g[:-1] in grams[n - 1] and g[-1] in head:
                    c[g] += 1
        grams[n] = {g: k for g, k in c.items() if k >= max(2, arc_share * total)}

    def p(h, w):
        if not h:
            return (uni[w] + 0.1) / (total + 0.1 * (v + 1))
        n = len(h) + 1
        arcs = followers.get(h)
        if not arcs:
            return p(h[1:], w)
        if w in arcs:
            return (grams[n][(*h, w)] - 0.75) / grams[n - 1][h]
        left = 1 - sum((grams[n][(*h, x)] - 0.75) / grams[n - 1][h] for x in arcs)
        return p(h[1:], w) * max(left, 1e-9) / max(1 - sum(p(h[1:], x) for x in arcs), 1e-9)

    followers = {}
    for n in range(2, order + 1):
        for g in grams[n]:
            followers.setdefault(g[:-1], set()).add(g[-1])
    return uni, total, v, p


def texts(seed=3):
    rnd = random.Random(seed)
    pool = ["The", "of", "and", "cat", "É", "dog", "ran"] + [f"w{k}" for k in range(40)]
    weights = [30, 20, 20, 10, 10, 10, 8] + [1] * 40
    out = [(i, " ".join(rnd.choices(pool, weights, k=rnd.randint(0, 40)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \n "), (None, out[1][1]), (103, "never seen words"), (5, out[5][1]), (6, "the other of"), (104, "the " * 400)]
    rnd.shuffle(out)
    return out


def test_matches_plain_recursion_with_nulls_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 300)
    monkeypatch.setattr(L, "LANE", 5)
    rows = texts()
    df = spark.createDataFrame([(i, t, 1.5, 2) for i, t in rows], "doc_id long, text string, score double, n long").repartition(4)
    for order, head_share, arc_share in ((3, 0.01, 0.002), (4, 0.004, 0.001), (1, 0.01, 0.01)):
        uni, total, v, p = model(rows, order, head_share, arc_share)
        want = []
        for i, t in rows:
            toks = split(t)
            s = ["<s>", *toks]
            score = sum(math.log10(p(tuple(s[max(0, k + 1 - order + 1):k + 1]), w)) for k, w in enumerate(toks))
            base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (v + 1))) for w in toks)
            want.append((str(i), is_held(i), len(toks), sum(uni[w] > 0 for w in toks), total, base, score))
        got = L.score(df, order, head_share, arc_share).collect()
        got = sorted(((str(r[0]), *r[1:]) for r in got), key=lambda r: (r[0], r[2], r[5]))
        want.sort(key=lambda r: (r[0], r[2], r[5]))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    rnd = random.Random(1)
    cycle = ["a", "b", "c", "d", "e", "f"]
    rows = [(i, " ".join(cycle[(k + i) % 6] for k in range(rnd.randint(20, 60)))) for i in range(200)]
    out = L.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert out and all(r.score > r.base_score * 0.5 for r in out)


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rare_words_and_n_grams_keep_their_arcs_however_large_the_corpus(spark, monkeypatch):
    rows = texts(4) + [(200 + i, "quite rare pair of words") for i in range(4)] + [(300 + i, "the cat ran " * 15000) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    uni, total, v, p = model(rows, 3, 0, 0)
    want = {i: sum(math.log10(p(tuple(["<s>", *split(t)][max(0, k - 1):k + 1]), w)) for k, w in enumerate(split(t))) for i, t in rows if i and 200 <= i < 300}
    for size, lane in ((1 << 20, 256), (40_000, 7)):  # neither shards nor lanes change scores
        monkeypatch.setattr(L, "SHARD", size)
        monkeypatch.setattr(L, "LANE", lane)
        got = {r.doc_id: r.score for r in L.score(df).where("doc_id >= 200 and doc_id < 300").collect()}
        assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()))
