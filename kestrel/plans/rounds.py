"""Rounds (G4-G8): retrieve -> re-rank -> merge beams -> gate -> expand ->
pseudo-label -> train -> predict, with each round's outputs written as tables
and read back by the next round (lineage never grows across rounds).

Loops over categories and beams do not exist: they are columns.  The only
driver loops are over rounds and, inside X10, over beam numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.text import lemma_map
from kestrel.operators.beams import carry_over, initial_beams, merge_beams
from kestrel.operators.classify import fit_classifier, predict
from kestrel.operators.expand import expand, gate, lemma_vocabulary, pair_score_term, rank_candidates, three_way_scores, top_candidates
from kestrel.operators.pseudo import pseudo_labels
from kestrel.operators.rerank import SparseIndex, _scratch, bm25, build_index, index_of, rerank, retrieve
from kestrel.operators.retrieval import threshold as min_score
from kestrel.operators.tfidf import block_lexicon, corpus_tfidf, raw_blocks, shared_terms, tfidf
from kestrel.operators.soft_targets import hashed_terms
from kestrel.session import cut_lineage, spread
from kestrel.plans.run_store import Part, content_key, key_of, manifest, publish
from kestrel.sources.io import add_tfidf, write_json

#: Hashed features of the rounds' classifier.
NUM_FEATURES = 1 << 16
#: The parts of a corpus, and what the index's lists are read as.
PARTS = {"index", "lemmas", "global_scores", "hashed"}
VIEWS = {"weights": "index", "lemmas": "index"}


@dataclass
class RoundConfig:
    categories: dict            # category -> seed query
    num_beams: int = 3
    k_first: int = 600
    k_rerank: int = 300
    ce_threshold: float | None = 0.0
    strategy: str = "union"
    samples_per_class: int | None = 100
    conf_threshold: float = 0.6
    min_docs: int = 50
    w_local: float = 0.4
    w_spec: float = 0.6
    reg_grid: tuple = (0.0, 0.01)
    train_model: bool = True


class Corpus:
    """Everything computed once per corpus and reused by every round (K5, K8).

    The corpus is tokenised once and its distinct tokens are lemmatised once; the index (M1), whose lists are the lemma set (for J9) as well, the global term
    scores (X2, K8) and the classifier's features (M6, M7) are derived from that, each when it is first asked for: a query
    that asks for hits alone does not wait for the other tables.

    With ``folder`` (shared storage, named by the corpus's content) the tables last, a folder and a manifest for each of these parts: a later
    call, also of another process, reads them there.  Once all parts are made, the folder's own manifest lists their tables and views.
    """

    def __init__(self, docs: DataFrame, folder: str | None = None):
        self.docs, self.folder, self._parts = docs.select("doc_id", "text"), folder, {}  # doc_id, text

    def _tables(self, name: str, make: Callable[[Callable[..., DataFrame]], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of a part, as stored, or made now: ``make`` is given what writes a table (table, name, partition columns)."""
        if name not in self._parts:
            part = Part(self.docs.sparkSession, f"{self.folder}/{name}") if self.folder else None
            stored = part.load() if part else None
            if stored:
                self._parts[name] = stored[0]
            else:
                self._parts[name] = make(part.put if part else _scratch)
                if part:
                    part.publish()
            if self.folder and self._parts.keys() >= PARTS and manifest(self.docs.sparkSession, self.folder) is None:
                tables = {t: part for part, tables in self._parts.items() for t in tables}
                publish(self.docs.sparkSession, self.folder, {"tables": tables | VIEWS})
        return self._parts[name]

    def _index(self) -> dict[str, DataFrame]:
        def make(put):
            blocks = cut_lineage(raw_blocks(self.docs))
            lex = put(block_lexicon(blocks), "lexicon")
            shared = put(shared_terms(cut_lineage(lemma_map(lex, "term", lex))), "shared")
            i = build_index(self.docs, blocks=blocks, lexicon=lex, shared=shared, put=put)
            return {"lexicon": lex, "shared": shared, "lists": i.lists, "terms": i.terms, "doc_lengths": i.docs, "n_docs": i.n_docs}
        return self._tables("index", make)

    def _lemmas(self) -> dict[str, DataFrame]:
        t = self._index()
        return self._tables("lemmas", lambda put: {"vocab": put(lemma_vocabulary(t["lexicon"], t["shared"]), "vocab")})

    @property
    def index(self) -> SparseIndex:
        t = self._index()
        return index_of(t["lists"], t["terms"], t["doc_lengths"], t["lexicon"], t["n_docs"])

    @property
    def n(self) -> DataFrame:
        """One row n."""
        return self._index()["n_docs"].select("n")

    @property
    def lemmas(self) -> DataFrame:
        """doc_id, term (all tokens, lemmatised), bucket."""
        return self._index()["lists"].select("term", "bucket", F.inline("docs")).select("doc_id", "term", "bucket")

    @property
    def lemma_blocks(self) -> DataFrame:
        """term, docs (array of doc_id, tf), bucket: ``lemmas`` as stored."""
        return self._index()["lists"].select("term", "docs", "bucket")

    @property
    def vocab(self) -> DataFrame:
        """The distinct terms of ``lemmas``."""
        return self._lemmas()["vocab"]

    @property
    def global_scores(self) -> DataFrame:
        """term, df, cf, score (cap 5000)."""
        def make(put):
            t = self._index()
            return {"global_scores": put(corpus_tfidf(t["lists"], t["n_docs"], 5000), "global_scores")}
        return self._tables("global_scores", make)["global_scores"]

    @property
    def hashed(self) -> DataFrame:
        """doc_id, idx: the classifier's features."""
        return self._tables("hashed", lambda put: {"hashed": put(
            hashed_terms(spread(self.docs), "text", NUM_FEATURES, "idx").select("doc_id", "idx"), "hashed")})["hashed"]

    def whole(self) -> Corpus:
        """Makes all parts."""
        self._index(), self._lemmas(), self.global_scores, self.hashed
        return self


def prepare_corpus(docs: DataFrame, folder: str | None = None) -> Corpus:
    """The corpus with all its parts, made or read."""
    return Corpus(docs, folder).whole()


@dataclass
class RoundResult:
    round: int
    beams: DataFrame         # category, beam_id, query, suggested_word, expanded_query
    hits: DataFrame          # merged hits: category, doc_id, beam_id, score, ce_score
    candidates: DataFrame
    pseudo: DataFrame        # review_id, text, label, ce_score, cosine_similarity
    predictions: DataFrame | None
    gated: DataFrame | None = None     # category, doc_id: documents that the gate left for expansion
    top_words: DataFrame | None = None  # category, term, score, rank
    summary: DataFrame | None = None    # category, total_unique_terms, total_documents
    used_model: bool = False


#: The tables of a round, as they are stored under ``root/round=N/``.
ROUND_TABLES = ("hits", "gated", "candidates", "pseudo", "top_words", "summary", "predictions", "beams")


def save_round(res: RoundResult, root: str) -> RoundResult:
    """K5, K6: a round's tables, then their manifest; the result reads them from there."""
    spark = res.beams.sparkSession
    part = Part(spark, f"{root}/round={res.round}")
    for name in ROUND_TABLES:
        if getattr(res, name) is not None:
            part.put(getattr(res, name), name)
    part.publish(round=res.round, used_model=res.used_model)
    return load_round(spark, root, res.round)


def load_round(spark: SparkSession, root: str, round_no: int) -> RoundResult | None:
    """A stored round, or None if it was not stored to its end."""
    stored = Part(spark, f"{root}/round={round_no}").load()
    if stored is None:
        return None
    tables, told = stored
    return RoundResult(round_no, used_model=told["used_model"], **{name: tables.get(name) for name in ROUND_TABLES})


def run_folder(docs: DataFrame, cfg: RoundConfig, dev: DataFrame | None, root: str, content: str | None = None) -> tuple[str, str]:
    """(folder of the run, folder of its corpus) under ``root``, named by what they are made from.

    ``content``: the documents' ``content_key``, for a caller that has it; else they are read for it.
    """
    corpus = key_of(content or content_key(docs.select("doc_id", "text")))
    run = key_of(corpus, content_key(dev), asdict(cfg))
    return f"{root}/run={run}", f"{root}/corpus={corpus}"


def stored_predictions(spark: SparkSession, run: str, n_rounds: int) -> DataFrame | None:
    """K6: the predictions of all stored rounds of a run, with their round number."""
    out = None
    for r in range(n_rounds):
        res = load_round(spark, run, r)
        if res is not None and res.predictions is not None:
            out = res.predictions if out is None else out.unionByName(res.predictions)
    return out


def run_round(spark: SparkSession, corpus: Corpus, cfg: RoundConfig, round_no: int,
              prev: RoundResult | None = None, dev: DataFrame | None = None) -> RoundResult:
    """One round (G4 + G5 + G6 + M6/M7) over all categories at once."""
    keys = ["category", "beam_id"]
    beams = carry_over(initial_beams(spark, cfg.categories, cfg.num_beams),
                       prev.beams if prev is not None else None, cfg.num_beams)
    beams = cut_lineage(beams)
    first = retrieve(corpus.index, beams, cfg.k_first, keys).join(beams, keys)  # G4: M2 + M3
    scored = rerank(bm25(corpus.index, first, keys, "query"), cfg.k_rerank, cfg.ce_threshold, keys)  # M4, L3, P12
    merged = cut_lineage(merge_beams(scored, cfg.strategy, "doc_id")
                         .select("category", "doc_id", "beam_id", "score", "ce_score"))  # W5/W7
    # Gate by last round's predictions, then expand every beam
    prev_pred = prev.predictions if prev is not None else None
    gated = gate(merged.withColumnRenamed("doc_id", "review_id"), prev_pred, cfg.conf_threshold, cfg.min_docs)
    # the hits' texts (categories x beams x k at most), fetched once: what follows never scans the corpus's texts again
    hits_text = cut_lineage(merged.join(corpus.docs, "doc_id"))
    left = gated.select("category", F.col("review_id").alias("doc_id"))
    texts = cut_lineage(hits_text.select("category", "doc_id", "text").join(left, ["category", "doc_id"], "left_semi"))
    cands, new_beams = expand(texts, beams, corpus.lemma_blocks, corpus.n, corpus.global_scores, corpus.index.lexicon,
                              cfg.num_beams, w_local=cfg.w_local, w_spec=cfg.w_spec, vocab=corpus.vocab)
    new_beams = cut_lineage(new_beams)
    # Pseudo labels from the merged hits
    labelled_text = hits_text.select(F.col("doc_id").alias("review_id"), "text", F.col("category").alias("label"),
                                     "ce_score", F.col("score").alias("cosine_similarity"))
    pseudo = cut_lineage(pseudo_labels(labelled_text, cfg.samples_per_class))
    predictions = None
    if cfg.train_model and dev is not None:  # M6 + M7 (K6)
        labelled = pseudo.select(F.col("review_id").alias("doc_id"), "label").join(corpus.hashed, "doc_id")
        model, labels, _ = fit_classifier(labelled, hashed_terms(dev, "text", NUM_FEATURES, "idx"), reg_grid=cfg.reg_grid, max_iter=30,
                                          num_features=NUM_FEATURES, idx_col="idx")
        predictions = cut_lineage(
            predict(model, labels, corpus.hashed, idx_col="idx")
            .select(F.col("doc_id").alias("review_id"), "predicted_label_id", "predicted_label", "confidence",
                    "probs")
            .withColumn("round", F.lit(round_no)))
    local = tfidf(texts, ["category"], max_features=1000, lexicon=corpus.index.lexicon)
    return RoundResult(round_no, new_beams, merged, cands, pseudo, predictions, texts.select("category", "doc_id"),
                       local.top(20), local.summary, prev_pred is not None)


def run_rounds(spark: SparkSession, docs: DataFrame, cfg: RoundConfig, n_rounds: int,
               dev: DataFrame | None = None, root: str | None = None, content: str | None = None) -> list[RoundResult]:
    """Rounds in sequence; each reads the previous round's written tables.

    With ``root`` (shared storage) a run's tables lie in a folder named by its corpus, development set and settings
    (``run_store``); a restarted job goes on after the last round that was stored to its end, and a job with other rows or
    settings starts anew beside it.  A corpus part is made when a round asks for it.  ``content``: as in ``run_folder``.
    """
    run, corpus_at = run_folder(docs, cfg, dev, root, content) if root else (None, None)
    corpus, out, prev = None, [], None
    for r in range(n_rounds):
        stored = load_round(spark, run, r) if run else None
        if stored is None:
            corpus = corpus or Corpus(docs, corpus_at)
            stored = run_round(spark, corpus, cfg, r, prev, dev)
            stored = save_round(stored, run) if run else stored
        prev = stored
        out.append(prev)
    return out


def round_document(res: RoundResult, cfg: RoundConfig, docs: DataFrame | None = None) -> DataFrame:
    """K3: the nested round result, one row per category, with its reviews (at most beams x ``k_rerank``), beams, words (K4)
    and best expansion candidates (X7).

    ``docs`` (doc_id, text): the corpus, for the reviews' texts and the corpus size.
    """
    beams = res.beams.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(
        "beam_id", "query", "suggested_word", "expanded_query"))).alias("beams"))
    counts = res.hits.groupBy("category").agg(F.count(F.lit(1)).alias("total_after_merging"))
    hits = res.hits
    if docs is not None:  # the hits' texts are found where they lie: an outer join would move the whole corpus
        found = cut_lineage(docs.select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
        hits = hits.join(found, "doc_id", "left")
    review = F.struct((-F.col("ce_score")).alias("_s"), F.col("doc_id").alias("review_id"), F.col("score").alias("cosine_similarity"), "ce_score",
                      *([] if docs is None else ["text"]))
    reviews = (hits.groupBy("category").agg(F.sort_array(F.collect_list(review)).alias("_r"))
               .select("category", F.transform("_r", lambda r: r.dropFields("_s")).alias("reviews")))
    per_cat = (beams.join(counts, "category", "left").withColumn("total_after_merging", F.coalesce("total_after_merging", F.lit(0)))
               .join(reviews, "category", "left").withColumn("used_model_filtering", F.lit(res.used_model)))
    per_cat = per_cat.withColumn("reviews", F.coalesce("reviews", F.array().cast(per_cat.schema["reviews"].dataType)))
    if res.gated is not None:
        left = res.gated.groupBy("category").agg(F.count(F.lit(1)).alias("filtered_doc_count"))
        per_cat = per_cat.join(left, "category", "left").withColumn("filtered_doc_count", F.coalesce("filtered_doc_count", F.lit(0)))
    if res.top_words is not None and res.summary is not None:
        per_cat = add_tfidf(per_cat, res.top_words, res.summary, "category")
    per_cat = per_cat.join(stored_candidates(res.candidates), "category", "left")
    extra = [c for c in ("reviews", "used_model_filtering", "filtered_doc_count", "tfidf_analysis", "query_expansion") if c in per_cat.columns]
    n = F.lit(docs.count() if docs is not None else None).cast("long")
    return per_cat.select(
        F.lit(res.round).alias("round"), "category", F.lit(cfg.k_first).alias("k_biencoder"), F.lit(cfg.k_rerank).alias("k_crossencoder"),
        F.lit(cfg.ce_threshold).alias("ce_threshold"), n.alias("total_reviews_corpus"), F.lit(res.round > 0).alias("used_expanded_queries"),
        F.lit(cfg.num_beams).alias("num_beams"), F.lit(cfg.strategy).alias("beam_strategy"), F.lit(cfg.k_first).alias("total_biencoder_retrieved"),
        "total_after_merging", "beams", *extra)


def stored_candidates(cands: DataFrame, n: int = 10) -> DataFrame:
    """(category, query_expansion): the first ``n`` candidates of each beam."""
    best = top_candidates(cands, n)
    return best.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("beam_id", "top_candidates"))).alias("query_expansion"))


def write_round_document(res: RoundResult, cfg: RoundConfig, path: str, docs: DataFrame | None = None) -> DataFrame:
    """K3: the document as JSON lines in a folder per round and category; returned as read from there."""
    doc = round_document(res, cfg, docs)
    write_json(doc, path, ["round", "category"])
    return doc.sparkSession.read.schema(doc.schema).json(path)


def single_query_report(corpus: Corpus, spark: SparkSession, query: str, k: int = 100,
                        threshold: float = 0.5, top_n: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One query -> top-k -> similarity threshold -> TF-IDF of the kept texts -> candidates, scored three ways
    (X6) -> (hits, candidates, stored top candidates (X7))."""
    index = corpus.index
    q = spark.createDataFrame([("q", 1, query)], "category string, beam_id int, query string")
    hits = cut_lineage(min_score(retrieve(index, q, k, ["category", "beam_id"]), threshold))  # k rows, read several times
    texts = cut_lineage(hits.select("category", "doc_id").join(corpus.docs, "doc_id"))
    cands = cut_lineage(rank_candidates(texts, q, corpus.lemma_blocks, corpus.n, corpus.global_scores, index.lexicon,
                                        top_n=top_n, w_local=0.6, w_spec=0.4, vocab=corpus.vocab))
    scored = three_way_scores(cands, pair_score_term(index, cands, hits))
    return hits, scored, top_candidates(scored)


def setup_corpus(reviews: DataFrame, stratum: str | None = "label", dev_size: float = 0.15, test_size: float = 0.2,
                 seed: int = 42, id_col: str = "review_id") -> tuple[DataFrame, Corpus]:
    """Stratified 3-way split (L8), then the index over the train split only (M1, K5).

    Returns the split table (written) and the train corpus artefacts.
    """
    from kestrel.operators.split import train_dev_test_split
    split = cut_lineage(train_dev_test_split(reviews, id_col, stratum, dev_size, test_size, seed))
    train = split.where(F.col("split") == "train").select(F.col(id_col).alias("doc_id"), "text")
    return split, Corpus(train)


def length_profile(df: DataFrame, text_col: str = "text", token_counter=None) -> dict:
    """Character and token statistics, histograms and per-model truncation."""
    from kestrel.operators.profile import (
        TOKEN_EDGES, TOKEN_LABELS, length_histogram, length_stats, over_limit, prefix_share, with_token_length,
    )
    d = with_token_length(df.withColumn("char_length", F.length(text_col)), text_col, "token_length",
                          token_counter)
    return {"chars": length_stats(d, "char_length", "samp"), "char_bins": length_histogram(d, "char_length"),
            "tokens": length_stats(d, "token_length", "pop"),
            "token_bins": length_histogram(d, "token_length", TOKEN_EDGES, TOKEN_LABELS, max_tokens=256),
            "over_limit": over_limit(d, "token_length"), "prefixed": prefix_share(d, text_col)}


def diagnose(hits: DataFrame, predictions: DataFrame, threshold: float = 0.5, order_col: str | None = None) -> dict:
    """Duplicate summary, overlap sets, prediction coverage, unexpected hits, gate effect, ambiguity.

    ``order_col``: which of several predictions of an id is the last and counts (J5).
    """
    from kestrel.operators.diagnose import (
        category_overlap, duplicate_summary, gate_effect, multi_high_confidence, prediction_coverage,
        unexpected_hits,
    )
    return {"summary": duplicate_summary(hits), "overlap": category_overlap(hits),
            "coverage": prediction_coverage(hits, predictions),
            "unexpected": unexpected_hits(hits, predictions, threshold, order_col=order_col),
            "gate": gate_effect(hits, predictions, threshold, order_col=order_col),
            "multi_high_conf": multi_high_confidence(hits, predictions, threshold, order_col=order_col)}
