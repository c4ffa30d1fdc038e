import glob
import os
import subprocess
import sys

from kestrel.operators.rerank import SparseIndex
from kestrel.plans import run_store as R
from kestrel.plans.rounds import RoundConfig, load_round, prepare_corpus, run_folder, run_rounds, stored_predictions

ROWS = [(i, f"good pizza number {chr(97 + i % 20)}{chr(97 + i % 7)}" if i % 2 else "bad coffee shop there") for i in range(40)]
CFG = dict(num_beams=1, k_first=10, k_rerank=5, samples_per_class=5, reg_grid=(0.0,))


def docs_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_another_corpus_or_setting_never_returns_an_old_round(spark, tmpdir_path):
    docs = docs_of(spark)
    first = run_rounds(spark, docs, RoundConfig({"en": "pizza"}, train_model=False, **CFG), 1, root=tmpdir_path)[0]
    assert first.hits.count() > 0 and [r.category for r in first.beams.collect()] == ["en"]
    other = run_rounds(spark, docs_of(spark, []), RoundConfig({"de": "coffee"}, train_model=False, **CFG), 1, root=tmpdir_path)[0]
    assert other.hits.count() == 0 and [r.category for r in other.beams.collect()] == ["de"]
    changed = run_rounds(spark, docs_of(spark, ROWS[:-1] + [(39, "pizza")]), RoundConfig({"en": "pizza"}, train_model=False, **CFG), 1, root=tmpdir_path)[0]
    assert changed.hits.count() > 0 and len(glob.glob(f"{tmpdir_path}/run=*")) == 3
    again = run_rounds(spark, docs.repartition(5), RoundConfig({"en": "pizza"}, train_model=False, **CFG), 1, root=tmpdir_path)[0]
    assert sorted(again.hits.collect()) == sorted(first.hits.collect()) and len(glob.glob(f"{tmpdir_path}/run=*")) == 3


def test_an_unpublished_round_is_made_again_and_predictions_are_read_back(spark, tmpdir_path):
    docs = docs_of(spark)
    dev = spark.createDataFrame([(1, "pizza number", "en"), (2, "coffee shop", "de")], "doc_id long, text string, label string")
    cfg = RoundConfig({"en": "pizza", "de": "coffee"}, **CFG)
    run_rounds(spark, docs, cfg, 1, dev, tmpdir_path)
    run, corpus = run_folder(docs, cfg, dev, tmpdir_path)
    assert R.manifest(spark, f"{corpus}")["tables"].keys() >= {"weights", "lemmas", "hashed"}
    pred = stored_predictions(spark, run, 2)
    assert pred.count() == 40 and {r["round"] for r in pred.select("round").distinct().collect()} == {0}
    before = R.manifest(spark, f"{run}/round=0")
    os.replace(f"{run}/round=0/manifest.json", f"{tmpdir_path}/taken-away.json")
    assert load_round(spark, run, 0) is None
    run_rounds(spark, docs, cfg, 1, dev, tmpdir_path)
    after = R.manifest(spark, f"{run}/round=0")
    assert after["tables"].keys() == before["tables"].keys() and after["tables"] != before["tables"]


def test_content_key_ignores_order_and_sees_nulls_and_repeats(spark):
    a = docs_of(spark)
    assert R.content_key(a) == R.content_key(a.repartition(7))
    keys = {R.content_key(docs_of(spark, rows)) for rows in (ROWS, ROWS + ROWS[:1], ROWS[1:], ROWS[1:] + [(0, None)], ROWS[1:] + [(0, "")], [])}
    assert len(keys) == 6


SECOND = """
import sys
sys.path.insert(0, {repo!r})
from kestrel.session import get_session
from kestrel.plans import rounds
spark = get_session("local[2]", shuffle_partitions=2, driver_memory="2g")
rounds.cut_lineage = None  # nothing may be built
docs = spark.createDataFrame([], "doc_id long, text string")
print("FOUND", rounds.prepare_corpus(docs, {folder!r}).index.weights.count())
"""


def test_a_second_process_reads_the_corpus_tables(spark, tmpdir_path):
    built = prepare_corpus(docs_of(spark), tmpdir_path + "/corpus")
    assert isinstance(built.index, SparseIndex)
    code = SECOND.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder=tmpdir_path + "/corpus")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert f"FOUND {built.index.weights.count()}" in out.stdout, out.stderr[-2000:]
