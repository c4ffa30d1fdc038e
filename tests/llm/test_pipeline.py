"""The pipeline against its stages' plain versions, and the guard that lets it be absent."""

import random
import subprocess
import sys

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from kestrel.llm import decontaminate as D, perplexity as Q
from tests.llm import brute
from tests.llm.test_decontaminate import plain, score
from tests.llm.test_line_dedup import expected


def corpus(seed=11):
    rnd = random.Random(seed)
    syll = ["an", "er", "th", "on", "in", "ing", "re", "st", "\u00e9"]
    word = lambda: "".join(rnd.choice(syll) for _ in range(rnd.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(8, 20)))
    shared = [line() for _ in range(4)]
    items = [(k, line() + " " + line()) for k in range(5)]
    docs = []
    for i in range(70):
        lines = [line() for _ in range(rnd.randint(6, 15))]
        if i % 4 == 0:
            lines[2:2] = shared
        if i % 9 == 1:
            lines.insert(1, items[i % 5][1].upper())
        docs.append((i, "\n".join(lines)))
    for i in range(70, 85):
        w = docs[rnd.randrange(70)][1].split(" ")
        w[rnd.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    docs += [(90, docs[3][1]), (91, None), (92, ""), (93, "short text"), (94, "again and again " * 40)]
    rnd.shuffle(docs)
    return docs, items


def test_pipeline_matches_plain_versions(spark, tmpdir_path):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    kept = {r.doc_id for r in Q.judge(df).where("kept").collect()}
    rows = [(i, t) for i, t in docs if i in kept]
    assert 0 < len(rows) < len(docs)
    rows = [(i, t) for i, t, *_ in expected(rows, 3)]
    prints = {i: brute.fingerprint(t) for i, t in rows}
    label = brute.components(sorted(set(prints.values())), lambda a, b: bin(a ^ b).count("1") <= 3)
    first = {}
    for i, _ in sorted(rows):
        first.setdefault(label[prints[i]], i)
    rows = [(i, t) for i, t in rows if i in first.values()]
    leaked = {i for i, t in rows for _, q in items if score(plain(q), plain(t)) / (D.MATCH * len(plain(q))) >= D.THRESHOLD}
    assert leaked
    rows = [(i, t) for i, t in rows if i not in leaked]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    got = {}
    for r in P.run(spark, tmpdir_path).collect():
        assert r.doc_tokens == want[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_stages_take_empty_and_extra_columns(spark, tmpdir_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, rank int, copy string, fp long, pos int")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, tmpdir_path)
        assert docs.columns[-4:] == ["rank", "copy", "fp", "pos"]
    assert P.STAGES[-1][1](spark, docs, tmpdir_path).count() == 0


def test_entry_works_without_the_subpackage(tmpdir_path):
    code = f"""
import importlib.util as u, sys
sys.path.insert(0, {sys.path[0]!r})
find = u.find_spec
u.find_spec = lambda n, *a: None if n == 'kestrel.llm' else find(n, *a)
import __spark_entry__ as e
assert e.queries() and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries())
"""
    import os
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
