import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from kestrel.llm import queries, ranked_search as R
from scripts.oracle_check import TABLES, digest


def brute(docs, items, top):
    bags = [(i, Counter(t.decode() for t in R.terms(x))) for i, x in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 20 * m))
                    for t in {t.decode() for t in R.terms(text)} if b[t])
            if s > 0:
                found.append((-s, i is not None, i or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["É", "été", "ÀB", "A-b"]
    docs = [(rnd.randint(0, 10 ** 6), " ".join(rnd.choices(words, k=rnd.randint(0, 80)))) for _ in range(n)]
    docs += [(7, "the hot line " * 3)] * 40 + [(None, "w1 w2 the"), (8, None), (9, ""), (11, "... --"), (12, "w3 " * 20000)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 40)))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (3, "the hot w1 w1 W1"), (3, "the hot w1 w1 W1"), (None, "line")]
    return docs, items


def run(spark, docs, items, **kw):
    top = kw.pop("top", 10)
    pairs = kw.pop("pairs", R.PAIRS)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, shard int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    out = R.search(R.build_index(d, **kw).cache(), q, top, pairs=pairs)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_brute_force_with_ties_nulls_and_repeats(spark):
    docs, items = corpus(1, 400)
    assert run(spark, docs, items) == brute(docs, items, 10)


def test_small_blocks_small_shards_and_several_blocks_of_items(spark):
    docs, items = corpus(2, 300)
    assert run(spark, docs, items, block=4, shard_docs=37, pairs=150, top=5) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = corpus(3, 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_blocks_below_the_threshold_are_not_unpacked():
    rnd = random.Random(5)
    found = [[b"common"] * rnd.randint(1, 3) + [b"w%d" % rnd.randint(0, 50) for _ in range(rnd.randint(1, 60))] + ([b"rare"] * 4 if k in (5, 900) else []) for k in range(4000)]
    rows = pa.Table.from_batches(list(R.shard_rows(0, list(range(4000)), found, 128)))
    n, total = 4000, sum(map(len, found))
    df = Counter(t.decode() for f in found for t in set(f))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    shard = R.Shard(rows, weight, n, total)
    docs, score = shard.best(["rare", "common"], 2, 1)
    assert set(docs.tolist()) >= {5, 900} and shard.unpacked <= 3  # the rare list, and two of 32 blocks of the common one


def test_packing_keeps_large_numbers(spark):
    gap, tf = np.array([0, 70000, 3, 0, 2]), np.array([1, 2, 300, 1, 1])
    start, count = np.array([0, 3]), np.array([3, 2])
    width, body = R.packed(gap, tf, start, count)
    assert width.tolist() == [4, 1]
    docs, back = R.unpacked(10, 3, 4, body[0].as_py())
    assert docs.tolist() == [10, 70010, 70013] and back.tolist() == [1, 2, 300]


def test_query_equals_its_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ours = queries.queries()["op12_ranked_search"](spark, sf)
    sql = con.sql(queries.oracle_sql()["op12_ranked_search"])
    assert sorted(ours.columns) == sorted(sql.columns)
    assert digest(ours.columns, [tuple(r) for r in ours.collect()])[0] == digest(sql.columns, sql.fetchall())[0]
