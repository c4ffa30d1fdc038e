"""Query expansion.

Per category the retrieved (optionally prediction-gated) texts give local
TF-IDF candidates; each candidate is filtered against its beam's query,
scored by local TF-IDF and by category specificity (substring document
frequency in the category's texts versus the whole corpus), min-max
normalised within (category, beam), combined, and assigned to beams.

Substring document frequency (J9) never compares candidates with documents, nor with the vocabulary: a k-gram
index of the lemma vocabulary gives the terms that hold all k-grams of a candidate, ``contains`` decides, and the
documents of those terms are counted.  The index is made of the vocabulary when it is asked (it has many rows a term and is much larger
than what a query meets); the (doc, lemma) table lies in buckets by key, so only the parts that the
candidates name are read; candidates are bounded by categories x ``top_n``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import GENERIC_BLACKLIST, WS_CLASS, lemma_map, valid_candidate
from kestrel.operators.predictions import dedupe_predictions
from kestrel.operators.lists import pruned
from kestrel.operators.relational import top_n
from kestrel.operators.tfidf import merge_by_term, raw_counts, shared_terms, tfidf
from kestrel.session import cut_lineage

GRAM = 3  # k of the k-gram index
EPS = 1e-6
SCORE_DIGITS = 9


# ---------------------------------------------------------------------------
# Gating (X8: P16, P17, J5)
# ---------------------------------------------------------------------------

def gate(hits: DataFrame, predictions: DataFrame | None, conf_threshold: float = 0.6, min_docs: int = 50,
         id_col: str = "review_id", category_col: str = "category", order_col: str | None = None) -> DataFrame:
    """P16 + P17: keep hits predicted as their category with confidence >= t;
    a category with fewer than ``min_docs`` such hits keeps all of its hits."""
    if predictions is None:
        return hits.withColumn("gated", F.lit(False))
    p = dedupe_predictions(predictions, id_col, order_col)
    # bounded by the hit set and read twice below: written once
    flagged = cut_lineage(hits.join(p, id_col, "left")
               .withColumn("gated", F.coalesce((F.col("predicted_label") == F.col(category_col))
                                               & (F.col("confidence") >= F.lit(conf_threshold)), F.lit(False)))
               .drop("predicted_label", "confidence"))
    counts = flagged.groupBy(category_col).agg(F.count_if("gated").alias("_ng"))
    return (flagged.join(counts, category_col)  # one row per category
            .where(F.col("gated") | (F.col("_ng") < min_docs)).drop("_ng"))


# ---------------------------------------------------------------------------
# Lemmatised text views and substring document frequency
# ---------------------------------------------------------------------------

def doc_lemmas(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               raw: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """Distinct (doc, lemma) over *all* tokens (stop words included): the lemmatised text as a set.

    ``raw`` (doc, token, tf) and ``shared`` (token, term: ``shared_terms``) may be passed in for the same corpus.
    """
    if raw is None:
        raw = cut_lineage(raw_counts(docs, id_col, text_col))
    if shared is None:
        shared = cut_lineage(shared_terms(lemma_map(raw.select(F.col("token").alias("term")), "term", lexicon)))
    return merge_by_term(raw.select(id_col, "token"), shared, lambda s: s.distinct()).select(id_col, "term")


def lemma_vocabulary(lexicon: DataFrame, shared: DataFrame) -> DataFrame:
    """The distinct terms of ``doc_lemmas``."""
    return merge_by_term(lexicon.select(F.col("term").alias("token")), shared, lambda s: s.distinct())


def gram_index(vocab: DataFrame, lengths: Sequence[int] = range(1, GRAM + 1)) -> DataFrame:
    """(gram, term): the distinct substrings of every term, of the given lengths."""
    n = F.explode(F.array(*[F.lit(x) for x in lengths]))
    return (vocab.select("term").distinct().withColumn("_n", n).where(F.length("term") >= F.col("_n"))
            .select("term", F.explode(F.array_distinct(_grams("term", F.col("_n")))).alias("gram")).select("gram", "term"))


def gram_rows(vocab: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """The rows of ``gram_index``, a gram as often as its term holds it: positions are rows, and no array of grams is made of a term."""
    at = (vocab.select("term").distinct().withColumn("_n", F.explode(F.array(*[F.lit(x) for x in lengths]))).where(F.length("term") >= F.col("_n"))
          .select("term", "_n", F.explode(F.sequence(F.lit(1), F.length("term") - F.col("_n") + 1)).alias("_at")))
    return at.select(F.substring("term", F.col("_at"), F.col("_n")).alias("gram"), "term")


def _grams(c: str, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda p: F.substring(F.col(c), p, n))


def substring_pairs(words: DataFrame, vocab: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """(word, term) for every vocabulary term that contains the word.

    A word's k-grams (k = ``GRAM``, or its length if that is less) are looked up in the gram index of the vocabulary; terms that
    hold all of them are candidates, and ``contains`` decides.  ``grams``: the stored index (``gram_index``); without it one is
    made of the lengths that the words need.
    """
    wd = words.select("word").distinct().where("word <> ''")
    parts = cut_lineage(wd.withColumn("_n", F.least(F.length("word"), F.lit(GRAM)))
                        .select("word", "_n", F.explode(F.array_distinct(_grams("word", F.col("_n")))).alias("gram")))
    if grams is None:
        lengths = sorted(r[0] for r in parts.select("_n").distinct().collect())  # GRAM numbers at most
        grams = gram_rows(vocab, lengths) if lengths else vocab.select(F.lit("").alias("gram"), "term").limit(0)
    whole = parts.groupBy("word").agg(F.count(F.lit(1)).alias("_all"))
    met = pruned(grams, parts, "gram").select("gram", "term").join(parts.select("word", "gram"), "gram")
    both = met.groupBy("word", "term").agg(F.count(F.lit(1)).alias("_k")).join(whole, "word")
    # a gram that a term repeats counts again: a term with all of them has _all at least
    return both.where((F.col("_k") >= F.col("_all")) & F.col("term").contains(F.col("word"))).select("word", "term")


def count_docs(words: DataFrame, pairs: DataFrame, dl: DataFrame, id_col: str = "doc_id",
               scope_cols: Sequence[str] = ()) -> DataFrame:
    """Per word (and scope): documents of ``dl`` (scope..., doc, term; without a scope also term, docs: array of doc) having a term that contains it."""
    scope = list(scope_cols)
    met = dl.join(pairs, "term")
    if "docs" in dl.columns:  # blocks meet their words whole, then they are taken apart
        met = met.select("word", F.explode("docs").alias(id_col))
    hits = met.select(*scope, id_col, "word").distinct()
    counts = hits.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("n"))
    return (words.select(*scope, "word").distinct()
            .join(counts, scope + ["word"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))


def count_docs_by_scope(words: DataFrame, pairs: DataFrame, dl: DataFrame, scopes: DataFrame, id_col: str = "doc_id",
                        scope_col: str = "category") -> tuple[DataFrame, DataFrame]:
    """``count_docs`` of ``words`` (scope, word) in the documents of their scope (``scopes``: scope, doc), and in all documents, from one pass over ``dl``.

    A document's scopes meet its words after these are told apart, so that both counts come from one short table: word, scopes, n.
    """
    met = dl.join(pairs, "term")
    if "docs" in dl.columns:  # blocks meet their words whole, then they are taken apart
        met = met.select("word", F.explode("docs").alias(id_col))
    held = cut_lineage(scopes.groupBy(id_col).agg(F.array_sort(F.collect_set(scope_col)).alias("_scopes")))  # its size is known to the join
    counted = cut_lineage(met.select(id_col, "word").distinct().join(held, id_col, "left").groupBy("word", "_scopes").agg(F.count(F.lit(1)).alias("n")))
    local = counted.select("word", F.explode("_scopes").alias(scope_col), "n").groupBy(scope_col, "word").agg(F.sum("n").alias("n"))
    whole = counted.groupBy("word").agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return (words.select(scope_col, "word").distinct().join(local, [scope_col, "word"], "left").withColumn("n", n),
            words.select("word").distinct().join(whole, "word", "left").withColumn("n", n))


def substring_df(words: DataFrame, dl: DataFrame, id_col: str = "doc_id", scope_cols: Sequence[str] = ()) -> DataFrame:
    """Per word (and scope), the number of documents with a lemma containing the word.

    ``words`` has ``word`` (+ scope columns); ``dl`` is (scope..., doc, term).
    """
    pairs = substring_pairs(words, dl)
    return count_docs(words, pairs, dl, id_col, scope_cols)


# ---------------------------------------------------------------------------
# Candidate scoring
# ---------------------------------------------------------------------------

def normalize_group(c: str, keys: Sequence[str]) -> Column:
    """Min-max within the group clipped to [0.001, 0.999]; all equal -> 0.5 (0.0 if all zero)."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    scaled = F.least(F.greatest((F.col(c) - lo) / (hi - lo), F.lit(0.001)), F.lit(0.999))
    return F.when(hi == lo, F.when(hi == 0.0, F.lit(0.0)).otherwise(F.lit(0.5))).otherwise(scaled)


def query_words(query: Column) -> Column:
    """Query tokens as in ``str.lower().split()`` (whitespace split, punctuation kept)."""
    return F.filter(F.split(F.lower(query), f"{WS_CLASS}+"), lambda t: t != "")


def filter_candidates(cands: DataFrame, beams: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per (category, beam): not blacklisted, length >= 3, no digit, not a query token or query-token lemma."""
    qt = beams.select("category", "beam_id", F.explode(F.array_distinct(query_words(F.col("query")))).alias("qtok"))
    lem = lemma_map(qt.select(F.col("qtok").alias("term")), "term", lexicon)
    qforms = (qt.join(lem.withColumnRenamed("term", "qtok"), "qtok", "left")
              .select("category", "beam_id", F.explode(F.array_distinct(F.array(
                  "qtok", F.coalesce("lemma", "qtok")))).alias("word")))
    black = F.array(*[F.lit(w) for w in GENERIC_BLACKLIST])
    per_beam = cands.join(beams.select("category", "beam_id", "query"), "category")
    kept = per_beam.where(~F.array_contains(black, F.lower("word")) & valid_candidate(F.col("word")))
    # U4: a multi-word candidate whose words are all query tokens adds nothing
    # (query lemmas are covered by the anti join below for single words).
    parts = F.split(F.lower("word"), " ")
    all_in_query = (F.size(parts) > 1) & (F.size(F.array_except(parts, query_words(F.col("query")))) == 0)
    kept = kept.where(~all_in_query)
    return kept.join(qforms, ["category", "beam_id", "word"], "left_anti")


def rank_candidates(texts: DataFrame, beams: DataFrame, corpus_lemmas: DataFrame, n_corpus: DataFrame,
                    global_scores: DataFrame | None, lexicon: DataFrame, *, top_n: int = 50,
                    w_local: float = 0.4, w_spec: float = 0.6, id_col: str = "doc_id",
                    limits: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """Candidates per (category, beam) with all scores, ``rank`` and ``final_rank``.

    ``limits`` (category, n_candidates) may ask for fewer than ``top_n`` in some categories.

    ``texts``: (category, doc, text) used for TF-IDF; ``beams``: (category,
    beam_id, query); ``corpus_lemmas``: (doc, term) of the whole corpus, or its blocks (term, docs: array of (doc, ...)); ``vocab``: its distinct terms;
    ``n_corpus``: one row ``n``; ``global_scores``: (term, score) or None.
    """
    local = tfidf(texts.select("category", id_col, "text"), ["category"], id_col=id_col,
                  max_features=1000, lexicon=lexicon)
    cands = local.top(top_n).select("category", F.col("term").alias("word"),
                                    F.col("score").alias("local_tfidf"), F.col("rank").alias("tfidf_rank"))
    if limits is not None:
        cands = (cands.join(limits, "category").where(F.col("tfidf_rank") <= F.col("n_candidates"))
                 .drop("n_candidates"))
    # Materialise the (small, bounded) candidate set: it feeds three branches and
    # the substring lengths; this is the one action inside the operator.
    filtered = cut_lineage(filter_candidates(cands, beams, lexicon))
    # specificity: local and global substring document frequency
    words = filtered.select("category", "word").distinct()
    # one (word, term) pair table from the corpus vocabulary serves both counts
    pairs = cut_lineage(substring_pairs(words, corpus_lemmas if vocab is None else vocab))
    corpus_lemmas = pruned(corpus_lemmas, pairs)  # the documents of those terms
    if "docs" in corpus_lemmas.columns:
        corpus_lemmas = corpus_lemmas.select("term", F.col(f"docs.{id_col}").alias("docs"))
    else:
        corpus_lemmas = corpus_lemmas.select(id_col, "term")
    ldf, gdf = count_docs_by_scope(words, pairs, corpus_lemmas, texts.select("category", id_col), id_col)
    ldf, gdf = ldf.withColumnRenamed("n", "ldf"), gdf.withColumnRenamed("n", "gdf")
    n_local = texts.groupBy("category").agg(F.countDistinct(id_col).alias("L"))
    spec_in = (filtered.join(ldf, ["category", "word"]).join(gdf, "word")
               .join(n_local, "category").crossJoin(F.broadcast(n_corpus.select(F.col("n").alias("G")))))
    ratio = (F.col("ldf") / F.col("L")) / (F.col("gdf") / F.col("G") + F.lit(EPS))
    penalty = (F.size(F.split("word", " ")) - 1) * 0.5
    spec = (F.log1p(ratio) - penalty) if global_scores is not None else F.lit(0.0)
    keys = ["category", "beam_id"]
    scored = (spec_in.withColumn("category_specificity", spec)
              .withColumn("local_tfidf_normalized", normalize_group("local_tfidf", keys))
              .withColumn("category_specificity_normalized", normalize_group("category_specificity", keys))
              .withColumn("combined_score", F.lit(w_local) * F.col("local_tfidf_normalized")
                          + F.lit(w_spec) * F.col("category_specificity_normalized")))
    if global_scores is not None:
        g = global_scores.select(F.col("term").alias("word"), F.col("score").alias("_gs"))
        scored = scored.join(g, "word", "left").withColumn("global_tfidf", F.coalesce("_gs", F.lit(0.0))).drop("_gs")
    else:
        scored = scored.withColumn("global_tfidf", F.lit(None).cast("double"))
    w_rank = Window.partitionBy(*keys).orderBy("tfidf_rank")
    w_final = Window.partitionBy(*keys).orderBy(F.desc(F.round("combined_score", SCORE_DIGITS)), F.asc("rank"))
    return (scored.withColumn("rank", F.row_number().over(w_rank))
            .withColumn("final_rank", F.row_number().over(w_final))
            .select("category", "beam_id", "query", "word", "local_tfidf", "local_tfidf_normalized",
                    "global_tfidf", "category_specificity", "category_specificity_normalized",
                    "combined_score", "rank", "final_rank"))


# ---------------------------------------------------------------------------
# Beam word assignment
# ---------------------------------------------------------------------------

def _not_in_query(word: Column, query: Column) -> Column:
    return (word != "") & (F.instr(F.lower(query), F.lower(word)) == 0)


def assign_same_query(cands: DataFrame, beams: DataFrame) -> DataFrame:
    """All beams share one query; the i-th eligible candidate (final order) goes to beam i."""
    first = cands.where(F.col("beam_id") == 1).where(_not_in_query(F.col("word"), F.col("query")))
    w = Window.partitionBy("category").orderBy("final_rank")
    picks = first.withColumn("beam_id", F.row_number().over(w)).select("category", "beam_id", "word")
    return _finish(beams, picks)


def assign_distinct_queries(cands: DataFrame, beams: DataFrame, num_beams: int) -> DataFrame:
    """Beams in order; each takes its best candidate not in its query and not used by an
    earlier beam of the same category.  A loop over beam numbers only (all categories per step)."""
    # bounded by categories x beams x top_n; materialised once for the per-beam steps
    eligible = cut_lineage(cands.where(_not_in_query(F.col("word"), F.col("query"))))
    picks = None
    for b in range(1, num_beams + 1):
        step = eligible.where(F.col("beam_id") == b)
        if picks is not None:
            used = picks.select("category", F.lower("word").alias("_lw"))
            step = (step.withColumn("_lw", F.lower("word"))
                    .join(used, ["category", "_lw"], "left_anti").drop("_lw"))
        w = Window.partitionBy("category").orderBy("final_rank")
        best = (step.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
                .select("category", "beam_id", "word"))
        picks = best if picks is None else picks.unionByName(best)
    return _finish(beams, picks)


def _finish(beams: DataFrame, picks: DataFrame) -> DataFrame:
    """X12 + F16: every beam gets a row; no word -> '' and the query unchanged."""
    out = beams.join(picks, ["category", "beam_id"], "left")
    word = F.coalesce(F.col("word"), F.lit(""))
    return out.select("category", "beam_id", "query", word.alias("suggested_word"),
                      F.when(word == "", F.col("query")).otherwise(F.concat_ws(" ", "query", word))
                      .alias("expanded_query"))


def all_same_query(beams: DataFrame) -> DataFrame:
    """X11: per category, whether all beam queries are equal."""
    return beams.groupBy("category").agg((F.countDistinct("query") == 1).alias("same_query"))


def expand(texts: DataFrame, beams: DataFrame, corpus_lemmas: DataFrame, n_corpus: DataFrame,
           global_scores: DataFrame | None, lexicon: DataFrame, num_beams: int, *,
           w_local: float = 0.4, w_spec: float = 0.6, id_col: str = "doc_id",
           vocab: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """X5 + X9/X10 + X11 for every category: returns (candidates, beams with expanded queries).

    Categories whose beams share one query use 50 candidates and X9; the
    others use 30 candidates per beam and X10.
    """
    same = all_same_query(beams)
    b_same = beams.join(same.where("same_query"), "category", "left_semi")
    b_diff = beams.join(same.where("NOT same_query"), "category", "left_semi")
    # one ranking for all categories, written once: the two assignments read their own part
    limits = same.select("category", F.when(F.col("same_query"), 50).otherwise(30).alias("n_candidates"))
    cands = cut_lineage(rank_candidates(texts, beams, corpus_lemmas, n_corpus, global_scores, lexicon,
                                        top_n=50, w_local=w_local, w_spec=w_spec, id_col=id_col, limits=limits, vocab=vocab))
    c_same = cands.join(same.where("same_query"), "category", "left_semi")
    c_diff = cands.join(same.where("NOT same_query"), "category", "left_semi")
    words = assign_same_query(c_same, b_same).unionByName(assign_distinct_queries(c_diff, b_diff, num_beams))
    return cands, words


# ---------------------------------------------------------------------------
# Three-way score (X6, A12) and stored top candidates
# ---------------------------------------------------------------------------

def pair_score_term(index, cands: DataFrame, hits: DataFrame, n_docs: int = 20, *,
                    id_col: str = "doc_id") -> DataFrame:
    """Mean pair score of ``query + ' ' + word`` over the category's first ``n_docs`` documents.

    ``hits`` has (category, doc, rank); a document that several beams hit counts at its best rank, ties by
    id.  The scorer is BM25 (M4).  Work is bounded by candidates x ``n_docs`` pairs.
    """
    from kestrel.operators.rerank import bm25
    best = hits.groupBy("category", id_col).agg(F.min("rank").alias("rank"))
    top = top_n(best, n_docs, [F.asc("rank"), F.asc(id_col)], ["category"], [id_col]).select("category", id_col)
    q = cands.select("category", "beam_id", "word", F.concat_ws(" ", "query", "word").alias("cq"))
    pairs = q.join(top, "category")  # candidates x n_docs per category
    scored = bm25(index, pairs, ["category", "beam_id", "word"], "cq", out="pair_score")
    return scored.groupBy("category", "beam_id", "word").agg(F.avg("pair_score").alias("pair_score"))


def three_way_scores(cands: DataFrame, pair: DataFrame, w_local: float = 0.3, w_pair: float = 0.5,
                     w_spec: float = 0.2) -> DataFrame:
    """combined = w_local*norm(local) + w_pair*norm(pair) + w_spec*norm(spec), re-ranked."""
    keys = ["category", "beam_id"]
    out = (cands.join(pair, keys + ["word"], "left").withColumn("pair_score", F.coalesce("pair_score", F.lit(0.0)))
           .withColumn("pair_score_normalized", normalize_group("pair_score", keys))
           .withColumn("combined_score", F.lit(w_local) * F.col("local_tfidf_normalized")
                       + F.lit(w_pair) * F.col("pair_score_normalized")
                       + F.lit(w_spec) * F.col("category_specificity_normalized")))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("combined_score", SCORE_DIGITS)), F.asc("rank"))
    return out.withColumn("final_rank", F.row_number().over(w))


def top_candidates(cands: DataFrame, n: int = 10) -> DataFrame:
    """The first n candidates (final order) stored per (category, beam) as an array."""
    return (cands.where(F.col("final_rank") <= n)
            .groupBy("category", "beam_id")
            .agg(F.array_sort(F.collect_list(F.struct("final_rank", "word", "combined_score"))).alias("top_candidates")))
