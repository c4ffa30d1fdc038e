import random
import re

import pytest

from kestrel.llm.line_dedup import dedup_lines
from tests.llm import brute


def rows(seed=1):
    rnd = random.Random(seed)
    pool = ["", "a", "b", "c d", "É", "license line", "x" * 40]
    out = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else f"own {i} {k}" for k in range(rnd.randint(1, 14)))) for i in range(50)]
    out += [(100, out[2][1]), (101, out[2][1]), (102, None), (103, ""), (None, out[3][1]), (104, "\n\n\n\n\n\n"), (105, "a\n" * 12),
            (7, out[7][1]), (8, "another\ntext\nhere")]
    rnd.shuffle(out)
    return out


def expected(data, m, min_words=50):
    texts = {(brute.order_key(i), t): t.split("\n") for i, t in data if t is not None}
    # the copy order of equal ids is text order, which the sorted keys have
    masks = brute.repeated_mask(texts, m)
    for d in range(1, m):
        seen = set()
        for key in sorted(texts):
            s = texts[key]
            for p in range(len(s) - d + 1):
                w = tuple(s[p:p + d])
                if w in seen and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in w) > min_words:
                    masks[key][p:p + d] = [True] * d
                seen.add(w)
    out = []
    for i, t in data:
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        lines, mask = t.split("\n"), masks[(brute.order_key(i), t)]
        runs = sum(1 for p, x in enumerate(mask) if x and (p == 0 or not mask[p - 1]))
        out.append((i, "\n".join(x for x, g in zip(lines, mask) if not g), len(lines), sum(mask), runs))
    return sorted(out, key=str)


@pytest.mark.parametrize("m, words", [(1, 50), (3, 50), (5, None), (3, 1), (5, 3)])
def test_matches_brute_force_with_nulls_ties_and_repeated_rows(spark, m, words):
    data = rows()
    df = spark.createDataFrame([(i, t, 5, 9, "k") for i, t in data], "doc_id long, text string, rank int, n_lines long, pos string").repartition(3)
    out = dedup_lines(df, m, counts=True, min_words=words)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.n_runs) for r in out.collect()), key=str)
    assert got == expected(data, m, float("inf") if words is None else words)
    assert {(r["rank"], r.pos) for r in out.collect()} == {(5, "k")}


def test_length_follows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 5), (2, "a\nb\nc\nd", 7)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, dedup_lines(df).collect())) == [(1, "a\nb\nc", 5), (2, "d", 1)]
    assert dedup_lines(df.limit(0)).collect() == []


def test_a_long_line_is_not_left_twice_and_clashing_columns_come_back(spark):
    long_line = " ".join(f"w{k}" for k in range(51))
    halves = " ".join(f"u{k}" for k in range(26)), " ".join(f"v{k}" for k in range(25))
    data = [(1, long_line), (2, f"own\n{long_line}\nown too"), (3, "\n".join(halves)), (4, "\n".join((*halves, "rest"))), (5, halves[0])]
    df = spark.createDataFrame([(i, t, f"a{i}", f"b{i}", i, "x", 7.0, "y", "z") for i, t in data],
                               "doc_id long, text string, _id string, _copy string, _listing long, _lines string, _runs double, _text string, _row string")
    out = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert {i: r.text for i, r in out.items()} == {1: long_line, 2: "own\nown too", 3: "\n".join(halves), 4: "rest", 5: halves[0]}
    assert all((r._id, r._copy, r._listing, r._lines, r._runs, r._text, r._row) == (f"a{i}", f"b{i}", i, "x", 7.0, "y", "z") for i, r in out.items())
