import random
import re

import numpy as np

from kestrel.llm import decontaminate as D


def score(item, text):
    """Smith-Waterman by the plain recurrence."""
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if a == b else -D.MISMATCH), h[i - 1][j] - D.GAP, h[i][j - 1] - D.GAP)
    return max(map(max, h))


def plain(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def test_alignment_matches_the_recurrence():
    rnd = np.random.default_rng(3)
    items = [rnd.integers(2, 7, rnd.integers(1, 12)) for _ in range(60)]
    texts = [rnd.integers(2, 7, rnd.integers(1, 25)) for _ in range(60)]
    got = D.align(D._padded(items, 0), D._padded(texts, 1))
    assert got.tolist() == [score(list(a), list(b)) for a, b in zip(items, texts)]


def data(seed=5):
    rnd = random.Random(seed)
    common = ["the", "of", "and", "a"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgÉ") for _ in range(rnd.randint(3, 6)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(rnd.randint(15, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (None, " ".join(text(20)))]
    docs, leaked = [], set()
    for i in range(60):
        body = text(rnd.randint(0, 120))
        if i % 3 == 0:
            k = rnd.randrange(12)
            copy = items[k][1].split()
            if i % 2:
                for _ in range(len(copy) // 8):
                    copy[rnd.randrange(len(copy))] = word()
                del copy[rnd.randrange(len(copy))]
            at = rnd.randint(0, len(body))
            body[at:at] = [x.upper() + "," for x in copy]
            leaked.add((i, items[k][0]))
        docs.append((i, rnd.choice([" ", "\n"]).join(body)))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, items[15][1]), (6, docs[6][1])]
    leaked |= {(None, 3), (102, None)}
    return docs, items, leaked


def test_matches_brute_force_with_nulls_ties_and_repeated_rows(spark):
    docs, items, leaked = data()
    d = spark.createDataFrame([(i, t, 1, 0.5) for i, t in docs], "doc_id long, text string, item_id int, score double").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in D.leaks(d, b).collect()}
    want = {}
    for i, t in set(docs):
        for k, q in set(items):
            a = plain(q)
            if len(a) >= D.SEED:
                s = score(a, plain(t)) / (D.MATCH * len(a))
                if s >= D.THRESHOLD:
                    want[i, k] = s
    assert got == want and leaked <= set(got)
    left = D.without_leaks(d, b)
    assert left.columns == d.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in {x for x, _ in want})


def test_a_benchmark_beyond_one_scan(spark, monkeypatch):
    docs, items, _ = data(8)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, D.leaks(d, b).collect()))
    monkeypatch.setattr(D, "SEEDS", 100)
    assert sorted(map(str, D.leaks(d, b).collect())) == one


def test_touching_leaks_of_several_scans_are_all_found(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda n: ["".join(rnd.choice("abcdefg") for _ in range(8)) for _ in range(n)]
    items, docs = [], []
    for k in range(8):
        short, long, far = text(4), text(12), text(30)
        items += [(3 * k, " ".join(short)), (3 * k + 1, " ".join(long)), (3 * k + 2, " ".join(far))]
        edited = long[:3] + text(2) + long[5:]
        docs.append((k, " ".join(short + edited + far[:14] + text(7) + far[14:] + text(9))))
    docs.append(docs[0])
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.leaks(d, b).collect()), key=str)
    assert {(r[0], r[1]) for r in one} == {(k, 3 * k + j) for k in range(8) for j in range(3)}
    monkeypatch.setattr(D, "SEEDS", 60)
    assert sorted(map(tuple, D.leaks(d, b).collect()), key=str) == one


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "some words are here")], "doc_id long, text string")
    assert D.leaks(d, b).collect() == [] and D.leaks(full, b).collect() == []
    assert D.leaks(d, full.withColumnRenamed("doc_id", "item_id")).collect() == [] and D.without_leaks(full, b).count() == 1


def test_columns_named_like_keys_come_back(spark):
    from kestrel.llm.decontaminate import without_leaks
    rows = [(i, "some words of text number %d and a few more" % (i * i * 7919), f"a{i}", f"b{i}", 10 * i, "t", "r") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _copy string, _listing long, _text string, _row string")
    items = spark.createDataFrame([(1, "quite another passage of many words here")], "item_id long, text string")
    out = without_leaks(df, items)
    assert out.columns == df.columns
    got = set(map(tuple, out.collect()))
    assert got and got <= set(rows)
