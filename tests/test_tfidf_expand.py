"""X1, X3-X5, X9, X10, W11, W12, J9 against brute force on small fixtures."""

import math
from collections import Counter

from pyspark.sql import functions as F

from kestrel.functions.text import STOP_WORDS
from kestrel.operators.expand import (
    _finish, assign_distinct_queries, assign_same_query, normalize_group, substring_df,
)
from kestrel.operators.tfidf import tfidf

DOCS = {
    "g1": ["apple banana apple", "banana cherry", "apple cherry durian", "banana banana egg", "fig apple"],
    "g2": ["kiwi lemon", "lemon mango kiwi", "kiwi kiwi nut"],
    "g3": ["only one document here"],
}


def brute_tfidf(texts, max_features=1000):
    toks = [[w for w in t.split() if w not in STOP_WORDS and len(w) >= 2] for t in texts]
    n = len(texts)
    min_df = 1 if n < 5 else 2
    if 0.8 * n < min_df:
        return {}
    df = Counter(w for t in toks for w in set(t))
    cf = Counter(w for t in toks for w in t)
    vocab = [w for w in df if df[w] >= min_df and df[w] <= 0.8 * n]
    vocab = sorted(vocab, key=lambda w: (-cf[w], w))[:max_features]
    scores = Counter()
    for t in toks:
        tf = Counter(w for w in t if w in vocab)
        wts = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in tf.items()}
        nrm = math.sqrt(sum(v * v for v in wts.values()))
        for w, v in wts.items():
            scores[w] += v / nrm
    return {w: s / n for w, s in scores.items()}


def test_tfidf_matches_brute_force(spark):
    rows = [(g, i + 100 * k, t) for k, (g, ts) in enumerate(DOCS.items()) for i, t in enumerate(ts)]
    docs = spark.createDataFrame(rows, "grp string, doc_id long, text string")
    res = tfidf(docs, ["grp"], max_features=3)
    got = {(r.grp, r.term): r.score for r in res.terms.collect()}
    for g, ts in DOCS.items():
        exp = brute_tfidf(ts, 3)
        assert {t for (gg, t) in got if gg == g} == set(exp), g
        for t, s in exp.items():
            assert abs(got[(g, t)] - s) < 1e-9
    summ = {r.grp: (r.total_unique_terms, r.total_documents) for r in res.summary.collect()}
    assert summ["g3"] == (0, 1)  # one document: nothing survives max_df


def test_normalize_group_edges(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", 2.0), ("d", 1.0), ("d", 3.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = sorted((r.g, r.n) for r in df.select("g", normalize_group("x", ["g"]).alias("n")).collect())
    assert got == [("a", 0.5), ("a", 0.5), ("b", 0.0), ("b", 0.0), ("c", 0.5), ("d", 0.001), ("d", 0.5), ("d", 0.999)]


def test_substring_df_brute_force(spark):
    lem = {1: ["cat", "scatter"], 2: ["dog"], 3: ["concatenate", "dog"], 4: ["bird"]}
    dl = spark.createDataFrame([(d, t) for d, ts in lem.items() for t in ts], "doc_id long, term string")
    words = spark.createDataFrame([("cat",), ("dog",), ("zebra",), ("at",)], "word string")
    got = {r.word: r.n for r in substring_df(words, dl).collect()}
    brute = {w: sum(1 for ts in lem.values() if w in " ".join(ts)) for w in ["cat", "dog", "zebra", "at"]}
    assert got == brute


def _beams(spark, rows):
    return spark.createDataFrame(rows, "category string, beam_id int, query string")


def test_beam_words_same_query_fewer_candidates(spark):
    beams = _beams(spark, [("c", 1, "pub"), ("c", 2, "pub"), ("c", 3, "pub")])
    cands = spark.createDataFrame([("c", b, "pub", w, r) for b in (1, 2, 3)
                                   for w, r in [("pubs", 1), ("beer", 2)]],
                                  "category string, beam_id int, query string, word string, final_rank int")
    got = {r.beam_id: (r.suggested_word, r.expanded_query) for r in assign_same_query(cands, beams).collect()}
    # "pubs" is not a substring of "pub" -> eligible; "beer" second; beam 3 keeps its query
    assert got == {1: ("pubs", "pub pubs"), 2: ("beer", "pub beer"), 3: ("", "pub")}


def test_beam_words_distinct_queries_no_reuse(spark):
    beams = _beams(spark, [("c", 1, "wine bar"), ("c", 2, "wine list"), ("c", 3, "wine")])
    rows = [("c", 1, "wine bar", "list", 1), ("c", 1, "cellar", 2),
            ("c", 2, "wine list", "cellar", 1), ("c", 2, "wine list", "bar", 2),
            ("c", 3, "wine", "cellar", 1), ("c", 3, "wine", "bar", 2)]
    rows = [r if len(r) == 5 else ("c", 1, "wine bar", r[2], r[3]) for r in rows]
    cands = spark.createDataFrame(rows, "category string, beam_id int, query string, word string, final_rank int")
    got = {r.beam_id: r.suggested_word for r in assign_distinct_queries(cands, beams, 3).collect()}
    assert got == {1: "list", 2: "cellar", 3: "bar"}
    assert _finish is not None and F is not None


def test_gate_min_docs_fallback(spark):
    from kestrel.operators.expand import gate
    hits, preds = [], []
    for cat, n_gated in [("c49", 49), ("c50", 50)]:
        for i in range(60):
            rid = f"{cat}-{i}"
            hits.append((cat, rid))
            label = cat if i < n_gated else "other"
            preds.append((rid, label, 0.9))
    preds.append(("c50-0", "c50", 0.1))  # duplicate id: the higher confidence wins (J5)
    h = spark.createDataFrame(hits, "category string, review_id string")
    p = spark.createDataFrame(preds, "review_id string, predicted_label string, confidence double")
    got = {r.category: r.n for r in gate(h, p, 0.6, 50).groupBy("category").count()
           .withColumnRenamed("count", "n").collect()}
    assert got == {"c49": 60, "c50": 50}  # 49 < 50 -> all docs kept; 50 -> gated only
