import os

import pytest
from pyspark.sql import functions as F

from kestrel.functions import text as X
from kestrel.operators import relational as J
from kestrel.operators import rerank as R
from kestrel.operators.expand import count_docs, doc_lemmas, lemma_vocabulary, substring_pairs
from kestrel.operators.tfidf import apply_term_rules, corpus_tfidf, raw_blocks, raw_counts, raw_postings, shared_terms, tfidf
from kestrel.plans.rounds import Corpus, prepare_corpus

ROWS = [(1, "The cat and the Cats don't eat; boxes, box--fish... foxes"), (2, "cat"), (2, "cats fox 2"), (None, "cats box"), (None, "glass"), (3, None), (4, ""),
        (5, "glasses glass cats men man")]


def docs_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tokens_follow_the_published_patterns(spark):
    odd = ["don't can't n't isn't 'quoted' it's they've x2 42 bar/pub", "Cannot gonna GOTTA wanna, lemme;gimme canNOT cannots", "a,5 b, c 7:30 x:y ...end.. end. --dash a--b",
           "café École naïve «mot» “word” ‘it’", "tab\there nbsp em　wide\x1cfs\x85nel line", "'''a'''. 'b'.. c'.' dn't nn't n n'", "", " ", "a",
           "İstanbul ΣΣ straße 日本語 कख", "end\n", "cats''s dogs'll'"]
    df = spark.createDataFrame([(t,) for t in odd] + [(None,)], "text string")
    old = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.lower("text"), X.SPLIT_MARKS, " "), X.JOINED_WORDS, "$0 "), F.lit(X.TOKEN_PATTERN), 1)
    got = df.select("text", X.tokens("text").alias("t"), old.alias("o")).collect()
    assert [r.t for r in got] == [r.o for r in got] and sum(len(r.t or []) for r in got) > 40


@pytest.mark.parametrize("rows", [ROWS, ROWS[3:4] + ROWS[5:], []])
def test_counts_within_rows_equal_grouped_counts(spark, rows):
    docs = docs_of(spark, rows)
    old = raw_postings(docs.withColumn("_g", F.lit(0)), ["_g"], "doc_id", "text").select("doc_id", "token", "tf")
    assert rows_of(raw_counts(docs)) == rows_of(old)


def test_counting_unique_ids_moves_no_token(spark):
    assert "Exchange hash" not in raw_counts(docs_of(spark, ROWS[:2]))._jdf.queryExecution().executedPlan().toString()


def test_index_and_lemmas_equal_grouped_ones(spark):
    docs = docs_of(spark)
    raw = raw_postings(docs.withColumn("_g", F.lit(0)), ["_g"], "doc_id", "text")
    lex = raw.select(F.col("token").alias("term")).distinct()
    lem = X.lemma_map(lex, "term", lex)
    index = R.build_index(docs)
    assert rows_of(index.postings) == rows_of(apply_term_rules(raw, ["_g"], "doc_id", lex, lem).select("doc_id", "term", "tf"))
    terms = raw.join(lem.withColumnRenamed("term", "token"), "token", "left").select("doc_id", F.coalesce("lemma", "token").alias("term")).distinct()
    shared = shared_terms(lem)
    assert rows_of(doc_lemmas(docs, lex)) == rows_of(terms) == rows_of(doc_lemmas(docs, lex, raw=raw, shared=shared))
    assert rows_of(lemma_vocabulary(lex, shared)) == rows_of(terms.select("term").distinct())
    # cosine: a document that is the query has 1, also one without an id
    q = spark.createDataFrame([("a", "glass"), ("b", "cats box")], "qid string, query string")
    hit = R.retrieve(R.build_index(docs_of(spark, ROWS[3:4] + ROWS[5:])), q, 9, ["qid"]).where("qid = 'b'").first()
    assert hit.doc_id is None and hit.score > 0.99


@pytest.mark.parametrize("sent", [1, 2, 3, 50])
def test_frequent_keys_are_sent_and_others_meet_by_shuffle(spark, monkeypatch, sent):
    rows = spark.createDataFrame([(i, "abcde"[i % 5]) for i in range(40)], "i long, k string")
    table = spark.createDataFrame([("a", 9, 1.0), ("b", 9, 2.0), ("c", 5, 3.0), ("x", 4, 4.0), ("d", 1, 5.0)], "k string, df long, v double")
    monkeypatch.setattr(J, "SENT", sent)
    assert rows_of(J.join_frequent(rows, table, "k", "df")) == rows_of(rows.join(table, "k"))


def test_a_part_is_made_when_it_is_asked_for(spark, tmpdir_path):
    corpus = Corpus(docs_of(spark), tmpdir_path + "/c")
    q = spark.createDataFrame([("a", "cats")], "qid string, query string")
    assert R.retrieve(corpus.index, q, 9, ["qid"]).count() == 4
    assert os.listdir(tmpdir_path + "/c") == ["index"]
    assert prepare_corpus(docs_of(spark, []), tmpdir_path + "/c").index.weights.count() == corpus.index.weights.count()


def test_a_corpus_without_rows(spark):
    corpus = prepare_corpus(docs_of(spark, []))
    assert corpus.index.weights.count() == corpus.lemmas.count() == corpus.vocab.count() == corpus.hashed.count() == 0


def test_blocks_hold_a_token_of_many_documents_in_one_row(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"common word{'abcdefghij'[i % 10]} common") for i in range(100)]).coalesce(1)
    monkeypatch.setattr("kestrel.operators.tfidf.spread", lambda d: d)
    for at_most in (1, 7, 200_000):
        monkeypatch.setattr("kestrel.operators.tfidf.TOKEN_ROWS", at_most)
        blocks = raw_blocks(docs)
        assert blocks.count() == 11
        assert {r.token: sorted(map(tuple, r.docs)) for r in blocks.collect()}["common"] == [(i, 2) for i in range(100)]


def test_the_corpus_is_stored_once(spark, tmpdir_path):
    """Postings, lemmas and norms read the lists; no other table has a row for a document's term."""
    corpus = prepare_corpus(docs_of(spark), tmpdir_path + "/c")
    assert sorted(n.rsplit("-", 1)[0] for n in os.listdir(tmpdir_path + "/c/index") if "-" in n) == ["doc_lengths", "lexicon", "lists", "n_docs", "shared", "terms"]
    assert not [n for n in os.listdir(tmpdir_path + "/c/lemmas") if n.startswith("lemmas")]
    lex, shared = corpus.index.lexicon, corpus._index()["shared"]
    assert rows_of(corpus.lemmas.select("doc_id", "term")) == rows_of(doc_lemmas(docs_of(spark), lex, shared=shared))
    assert rows_of(corpus.index.terms.select("term", "df")) == rows_of(corpus.index.postings.groupBy("term").count())
    assert sorted(r.term for r in corpus.index.lists.where("not kept").collect()) == ["and", "do", "the"]


def test_a_round_makes_the_parts_that_it_asks_for(spark, tmpdir_path):
    from kestrel.plans.rounds import RoundConfig, run_rounds
    run_rounds(spark, docs_of(spark), RoundConfig({"a": "cats"}, 1, 9, 9, None, train_model=False), 1, root=tmpdir_path)
    made = next(n for n in os.listdir(tmpdir_path) if n.startswith("corpus="))
    assert sorted(os.listdir(f"{tmpdir_path}/{made}")) == ["global_scores", "index", "lemmas"]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:2], ROWS[:1], ROWS + [(i, "cats fox fox glass box") for i in range(10, 30)], [(i, f"cat word{'abcde'[i % 5]}") for i in range(9)], []])
@pytest.mark.parametrize("most", [2, 5000])
def test_global_scores_by_blocks_equal_grouped_ones(spark, rows, most):
    docs = docs_of(spark, rows)
    index = R.build_index(docs)
    old = tfidf(docs, [], max_features=most, post=index.postings).terms.select("term", "df", "cf", "score")
    got = corpus_tfidf(index.lists, index.n_docs, most)
    round_ = lambda df: [(t, d, c, round(s, 9)) for t, d, c, s in rows_of(df)]
    assert round_(got) == round_(old) and got.schema.simpleString() == old.schema.simpleString()


def test_blocks_meet_their_words_before_they_are_taken_apart(spark):
    corpus = Corpus(docs_of(spark))
    words = spark.createDataFrame([("cat",), ("ox",), ("a",), ("none",), ("",)], "word string")
    pairs = substring_pairs(words, corpus.vocab)
    blocks = corpus.lemma_blocks.select("term", F.col("docs.doc_id").alias("docs"))
    by_rows, by_blocks = (count_docs(words, pairs, dl) for dl in (corpus.lemmas.select("doc_id", "term"), blocks))
    assert rows_of(by_blocks) == rows_of(by_rows) and ("cat", 4) in rows_of(by_rows)
    plan = by_blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(docs") < plan.rindex("Join Inner")  # above it


def test_a_folder_lists_its_tables_once_all_parts_are_made(spark, tmpdir_path):
    from kestrel.plans.run_store import manifest
    corpus = Corpus(docs_of(spark), tmpdir_path + "/c")
    corpus.vocab, corpus.global_scores
    assert manifest(spark, tmpdir_path + "/c") is None
    corpus.hashed
    assert manifest(spark, tmpdir_path + "/c")["tables"].keys() >= {"lists", "weights", "lemmas", "vocab", "global_scores", "hashed"}
