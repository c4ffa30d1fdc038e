import random
from itertools import combinations

import numpy as np

from kestrel.llm import simhash as S
from tests.llm import brute


def test_any_five_positions_hold_a_posted_set():
    assert len(S.POSITIONS) == 14
    assert all(any(set(p) <= set(five) for p in S.POSITIONS) for five in combinations(range(8), 5))


def test_long_lists_link_as_pairs_do(monkeypatch):
    rnd = np.random.default_rng(2)
    low = rnd.integers(0, 1 << 12, 300).astype(np.uint64)
    fp = np.unique((low & np.uint64(63)) | (low >> np.uint64(6)) << np.uint64(56) | np.uint64(7 << 30))
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if bin(int(fp[a] ^ fp[b])).count("1") <= 3}
    pairs = lambda: {(min(x), max(x)) for i, j in S.list_pairs(fp, (1, 2, 3, 4), 3) for x in zip(i.tolist(), j.tolist())}
    assert pairs() == want
    monkeypatch.setattr(S, "PAIRWISE", 0)
    assert pairs() == want


def near_rows():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeÉXq") for _ in range(rnd.randint(1, 8)))
    rows = []
    for i in range(25):
        w = [word() for _ in range(rnd.randint(1, 250))]
        for _ in range(rnd.randint(1, 5)):
            v = list(w)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = word()
            rows.append((len(rows) * 3 + 1, " ".join(v)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[4][1]), (903, "Hello"), (904, "hello"), (5000, "hello WORLD"), (rows[2][0], rows[2][1])]
    rnd.shuffle(rows)
    return rows


def test_matches_brute_force_with_nulls_ties_and_repeated_rows(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string").repartition(4)
    prints = {t: brute.fingerprint(t) for _, t in rows}
    label = brute.components(sorted(set(prints.values())), lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for i, t in rows:
        c = label[prints[t]]
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, prints[t], least.get(label[prints[t]])) for i, t in rows), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == want
    assert len(set(label.values())) < len(label)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_columns_named_like_keys_come_back(spark):
    from kestrel.llm.simhash import keep_one
    rows = [(i, "some words of text number %d and a few more" % (i * i * 7919), f"a{i}", f"b{i}", 10 * i, "t", "r") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _copy string, _listing long, _text string, _row string")
    out = keep_one(df)
    assert out.columns == df.columns
    got = set(map(tuple, out.collect()))
    assert got and got <= set(rows)
