"""Queries of few hits move no texts of the corpus (F8-F21), and count words in one pass."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators.expand import count_docs, count_docs_by_scope, gram_index, gram_rows, substring_pairs
from kestrel.plans import pseudo_plans, rounds
from kestrel.session import cut_lineage


@pytest.fixture()
def hits(spark, monkeypatch):
    """A first stage of two hits, whose size a plan does not know."""
    rows = spark.createDataFrame([("en", 1, 3, 9.0, 0.5, "sea", 1, 1), ("en", 2, 3, 8.0, 0.5, "sea", 1, 1), ("en", 1, 5, 7.0, 0.4, "sea", 2, 2)],
                                 "category string, beam_id int, doc_id long, ce_score double, score double, query string, rank int, ce_rank int")
    made = rows.join(rows.select("doc_id").distinct().hint("merge"), "doc_id").select(*rows.columns)
    monkeypatch.setattr(pseudo_plans, "reranked", lambda spark, sf_dir: made)
    monkeypatch.setattr(pseudo_plans.driver, "table", lambda spark, sf_dir, name: cut_lineage(spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("sea "), F.col("id").cast("string")).alias("text"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30000")  # the documents are larger, the hits smaller
    yield made
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_labelled_hits_find_their_texts_where_they_lie(spark, hits, monkeypatch):
    plans = []
    monkeypatch.setattr(pseudo_plans, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df))
    out = pseudo_plans.labelled_hits(spark, "nowhere")
    assert sorted((r.review_id, r.label, r.text) for r in out.collect()) == [(3, "en", "sea 3"), (5, "en", "sea 5")]
    assert sum(plan.count("SortMergeJoin") for plan in plans) == 1  # the one of the fixture


def test_counts_by_scope_equal_separate_counts(spark):
    rows = [(1, "sea"), (1, "seas"), (2, "seal"), (3, "land"), (None, "sea"), (4, "island"), (4, "sea"), (9, "oversea"), (None, "land")]
    dl = spark.createDataFrame(rows, "doc_id long, term string")
    words = spark.createDataFrame([("a", "sea"), ("a", "land"), ("b", "land"), ("b", "none"), ("c", "sea"), (None, "sea")], "category string, word string")
    texts = spark.createDataFrame([("a", 1), ("a", 1), ("a", 4), ("b", 4), ("b", 3), ("a", None), (None, 2), ("c", 77)], "category string, doc_id long")
    pairs = substring_pairs(words, dl.select("term"))
    blocks = dl.groupBy("term").agg(F.collect_list("doc_id").alias("docs")).unionByName(spark.createDataFrame([("sea", [None]), ("land", [None])], "term string, docs array<long>"))
    local_dl = texts.distinct().join(dl, "doc_id")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = key(count_docs(words, pairs, local_dl, "doc_id", ["category"])), key(count_docs(words.select("word").distinct(), pairs, dl, "doc_id"))
    assert ("a", "sea", 2) in want[0] and ("sea", 5) in want[1]
    for form in (dl, blocks):
        local, whole = count_docs_by_scope(words, pairs, form, texts)
        assert (key(local), key(whole)) == want


def test_a_round_document_has_the_texts_of_its_hits_and_no_others_are_moved(spark):
    beams = spark.createDataFrame([("en", 1, "sea", "", "sea")], "category string, beam_id int, query string, suggested_word string, expanded_query string")
    hits = cut_lineage(spark.createDataFrame([("en", 1, 1, 0.5, 3.0), ("en", 2, 1, 0.4, 2.0), ("en", 99, 1, 0.3, 1.0)],
                                             "category string, doc_id long, beam_id int, score double, ce_score double"))
    cands = spark.createDataFrame([], "category string, beam_id int, word string, combined_score double, final_rank int")
    docs = spark.createDataFrame([(1, "one"), (2, None), (3, "three"), (None, "null")], "doc_id long, text string")
    res = rounds.RoundResult(0, beams, hits, cands, None, None)
    row = rounds.round_document(res, rounds.RoundConfig({"en": "sea"}), docs).first()
    assert [(r.review_id, r.text) for r in row.reviews] == [(1, "one"), (2, None), (99, None)] and row.total_reviews_corpus == 4


def test_words_are_found_in_terms_that_repeat_their_grams(spark):
    vocab = ["banana", "ananas", "nanana", "anna", "an", "ab", "aaaa", "aaa", "naïveté", "évété", "b"]
    words = ["ana", "anan", "nanan", "aaa", "aaaa", "an", "a", "té", "nab", "ananasb", "bananab"]
    terms = spark.createDataFrame([(t,) for t in vocab * 2], "term string")
    found = substring_pairs(spark.createDataFrame([(w,) for w in words], "word string"), terms)
    assert sorted(map(tuple, found.collect())) == sorted((w, t) for w in words for t in vocab if w in t)
    rows = gram_rows(terms, [1, 3])
    assert rows.where("term = 'aaaa'").count() == 4 + 2 and "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in gram_index(terms, [1, 3]).collect()}
