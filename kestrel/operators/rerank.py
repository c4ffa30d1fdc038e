"""Text encoder, sparse retrieval and re-ranking.

Default encoder (M1/M2): the TF-IDF weights of :mod:`kestrel.operators.tfidf`
over the whole corpus, L2-normalised per document.  The corpus is stored once, inverted: ``lists`` has for a term blocks of
(doc, tf), written in buckets of terms and sorted by term, so that a query reads only its terms' part of it.  A document "vector" is
its rows of the view ``weights`` (doc, term, tf) of that table; a term's idf and a document's norm lie once
in ``terms`` and ``docs``.  A query is encoded with
the same idf.  Cosine similarity is then ``sum(wq * tf * idf) / norm`` over shared terms:
an equi-join of the query-term table to the postings, aggregated per (query, doc) with a partial aggregate, and
a top-k.  No query x document product is ever formed; which side of a join is broadcast follows from measured sizes.

Pair scorer (M4): BM25 (k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) /
(df + 0.5))) from the same postings, read by their terms.  A user scorer can be
plugged in as an Arrow ``pandas_udf`` over (query, text).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import lemma_map
from kestrel.operators.tfidf import block_lexicon, is_stop, one_each, postings, raw_blocks, shared_terms
from kestrel.operators.lists import bucketed, pruned
from kestrel.operators.relational import best_n, null_safe_join
from kestrel.session import cut_lineage, shared_dir
from kestrel.sources.io import write_table

SCORE_DIGITS = 9


@dataclass
class SparseIndex:
    """Corpus statistics and normalised document weights."""
    weights: DataFrame   # id, term, tf (after the term rules), bucket: a view of ``lists``
    terms: DataFrame     # term, df, idf
    docs: DataFrame      # id, dl (terms after the term rules), norm (of its tf * idf)
    lexicon: DataFrame   # term (all corpus tokens)
    n_docs: DataFrame    # one row: n, avgdl
    id_col: str
    postings: DataFrame | None = None  # id, term, tf: ``weights`` without the bucket
    lists: DataFrame | None = None  # term, docs (array of id, tf), df, kept (by the term rules), bucket: all terms


def _scratch(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    if not by:
        return cut_lineage(df)
    path = shared_dir(df.sparkSession, name)
    write_table(df, path, by)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # a table without rows leaves no file to tell it


def lists_of(index: SparseIndex, terms: DataFrame) -> DataFrame:
    """The part of the postings that holds ``terms`` (column term)."""
    return pruned(index.weights, terms)


def ruled_lists(blocks: DataFrame, lexicon: DataFrame, shared: DataFrame, id_col: str = "doc_id",
                written: Callable[[DataFrame], DataFrame] = cut_lineage) -> tuple[DataFrame, DataFrame]:
    """(lists, terms): ``blocks`` of tokens (``raw_blocks``) as blocks of terms, and (term, df) of the terms that the rules keep.

    Only blocks of ``shared`` tokens are taken apart and added up by document and term; all others are moved whole.  A term that the rules drop (a stop
    word, a single letter) stays in the lists, as the lemmatised texts hold it, with ``kept`` false.
    """
    ok = ~is_stop(F.col("term")) & (F.length("term") >= 2)
    alone = (lexicon.withColumnRenamed("term", "token").join(shared.select("token"), "token", "left_anti")
             .select("token", F.col("token").alias("term"), F.col("n").alias("df")).withColumn("kept", ok))
    whole = blocks.join(alone, "token").select("term", "docs", "df", "kept")
    tf = F.sum(F.when(~is_stop(F.col("token")), F.col("tf")).otherwise(0))
    added = written(blocks.join(shared, "token").select("token", "term", F.inline("docs")).groupBy(id_col, "term").agg(tf.alias("tf")))
    counted = added.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    merged = one_each(added.join(counted, "term").withColumn("kept", ok & (F.col("tf") > 0)), id_col, "term", "df", "kept")
    terms = alone.where("kept").select("term", "df").unionByName(counted.where(ok & (F.col("df") > 0)))
    return whole.unionByName(merged), terms


def rows_of_lists(lists: DataFrame) -> DataFrame:
    """(term, id, tf, and bucket if there is one) of the kept terms."""
    kept = F.coalesce("kept", F.lit(False))  # not for the reader, whose filters begin with the query's terms
    return lists.where(kept).select("term", *[c for c in lists.columns if c == "bucket"], F.inline("docs"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                materialize: bool = True, blocks: DataFrame | None = None, lexicon: DataFrame | None = None,
                shared: DataFrame | None = None, put: Callable[..., DataFrame] | None = None) -> SparseIndex:
    """M1: encode a corpus as TF-IDF postings with the norm of every document.

    The postings and lexicon are written once (Parquet in the shared
    checkpoint folder) so every query, beam and round reuses one tokenisation
    of the corpus, as the reference reuses its saved index.  ``blocks``
    (``raw_blocks``), ``lexicon`` (``block_lexicon``) and ``shared`` (token, term: ``shared_terms``) may be passed in when the
    caller already has them for the same corpus.  ``put`` (table, name, partition columns) writes a table where it should last and
    returns it as read from there.
    """
    put = put or _scratch
    keep = put if materialize else lambda df, name, by=None: df
    if blocks is None:
        blocks = raw_blocks(docs, id_col, text_col)
        blocks = cut_lineage(blocks) if materialize else blocks  # tokenise the corpus once
    lex = lexicon if lexicon is not None else keep(block_lexicon(blocks), "lexicon")
    if shared is None:
        shared = shared_terms(lemma_map(lex, "term", lex))
        shared = cut_lineage(shared) if materialize else shared
    # each table is written before the ones that read it, so nothing is computed twice
    lists, terms = ruled_lists(blocks, lex, shared, id_col, cut_lineage if materialize else lambda df: df)
    if materialize:  # sorted files per bucket: a query's terms name the folders, and the sorted terms the row groups, that it reads
        lists = keep(bucketed(lists.withColumn("_first", F.get("docs", F.lit(0))[id_col]), "term", "_first").drop("_first"), "lists", ["bucket"])
    n = docs.count()
    idf = F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1
    terms = keep(terms.withColumn("idf", idf), "terms")
    # numbers alone are shuffled, after sums by document within a task
    w = F.col("tf") * idf
    dl = keep(lists.where("kept").select("df", F.inline("docs")).groupBy(id_col)
              .agg(F.sum("tf").alias("dl"), F.sqrt(F.sum(w * w)).alias("norm")), "doc_lengths")
    total = dl.agg(F.sum("dl").alias("_tot"))
    n_docs = keep(total.select(F.lit(n).cast("long").alias("n"), (F.col("_tot") / F.lit(n)).alias("avgdl")), "n_docs")
    return index_of(lists, terms, dl, lex, n_docs, id_col)


def index_of(lists: DataFrame, terms: DataFrame, dl: DataFrame, lexicon: DataFrame, n_docs: DataFrame, id_col: str = "doc_id") -> SparseIndex:
    """The index over stored tables."""
    weights = rows_of_lists(lists)
    return SparseIndex(weights, terms, dl, lexicon, n_docs, id_col, weights.select(id_col, "term", "tf"), lists)


def encode_queries(index: SparseIndex, queries: DataFrame, key_cols: Sequence[str],
                   text_col: str = "query") -> DataFrame:
    """M2: query text -> (keys..., term, qweight) with the corpus idf, L2-normalised."""
    keys = list(key_cols)
    q = queries.select(*keys, text_col).withColumn("_qid", F.to_json(F.struct(*keys)))
    qp = postings(q.withColumn("_g", F.lit(0)), ["_g"], "_qid", text_col, index.lexicon,
                  materialize=False).drop("_g")
    qw = qp.join(index.terms.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    per_q = Window.partitionBy("_qid")
    qw = qw.withColumn("qweight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_q)))
    return qw.join(q.select("_qid", *keys), "_qid").select(*keys, "term", "idf", "qweight")


def retrieve(index: SparseIndex, queries: DataFrame, k: int, key_cols: Sequence[str],
             text_col: str = "query") -> DataFrame:
    """M3: top-k documents per query by cosine of TF-IDF vectors (keys..., id, score, rank)."""
    keys = list(key_cols)
    qt = encode_queries(index, queries, keys, text_col)
    qt = cut_lineage(qt)  # read twice: its terms choose the postings, then it meets them
    met = (lists_of(index, qt).select(index.id_col, "term", "tf")
           .join(qt, "term")
           .groupBy(*keys, index.id_col)
           .agg(F.sum(F.col("tf") * F.col("idf") * F.col("qweight")).alias("_s")))
    scored = (null_safe_join(met, index.docs.select(index.id_col, "norm"), [index.id_col])
              .select(*keys, index.id_col, F.round(F.col("_s") / F.col("norm"), SCORE_DIGITS).alias("score")))
    return best_n(scored, k, [F.desc("score"), F.asc(index.id_col)], keys, [index.id_col])


def bm25(index: SparseIndex, hits: DataFrame, key_cols: Sequence[str], query_col: str = "query",
         k1: float = 1.2, b: float = 0.75, out: str = "ce_score") -> DataFrame:
    """M4: BM25 of each (query, doc) hit; docs without a query term score 0."""
    keys = list(key_cols)
    idc = index.id_col
    hits = cut_lineage(hits)  # bounded by queries x k; read three times below
    qterms = postings(hits.select(*keys, query_col).distinct()
                      .withColumn("_qid", F.to_json(F.struct(*keys))).withColumn("_g", F.lit(0)),
                      ["_g"], "_qid", query_col, index.lexicon, materialize=False).select("_qid", "term")
    qterms = cut_lineage(qterms)  # read twice, as in retrieve
    pairs = hits.select(*keys, idc).withColumn("_qid", F.to_json(F.struct(*keys)))
    pair_terms = pairs.join(qterms, "_qid")  # hits x query terms: bounded by the hit set
    stats = index.terms.crossJoin(F.broadcast(index.n_docs))  # one-row scalar
    bm_idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    norm = F.lit(k1) * (1 - F.lit(b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    contrib = (pair_terms
               .join(lists_of(index, qterms).select(idc, "term", "tf"), [idc, "term"])
               .join(index.docs, idc)
               .join(stats, "term")
               .withColumn("_c", bm_idf * tf * (k1 + 1) / (tf + norm)))
    sums = contrib.groupBy("_qid", idc).agg(F.sum("_c").alias("_s"))
    return (hits.withColumn("_qid", F.to_json(F.struct(*keys)))
            .join(sums, ["_qid", idc], "left")
            .withColumn(out, F.round(F.coalesce(F.col("_s"), F.lit(0.0)), SCORE_DIGITS))
            .drop("_qid", "_s"))


def score_pairs(hits: DataFrame, scorer: Callable[[Column, Column], Column], query_col: str = "query",
                text_col: str = "text", out: str = "ce_score") -> DataFrame:
    """M4 with a user scorer: an Arrow ``pandas_udf(query, text) -> double``."""
    return hits.withColumn(out, scorer(F.col(query_col), F.col(text_col)))


def minmax(c: str, keys: Sequence[str]) -> Column:
    """(x - min) / (max - min) within the group; x unchanged when max == min."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.col(c))


def blend(hits: DataFrame, keys: Sequence[str], ce_col: str = "ce_score", first_col: str = "score",
          w: float = 0.8, out: str = "blended") -> DataFrame:
    """M5: ``w * norm(ce) + (1 - w) * norm(first stage)`` per query."""
    return hits.withColumn(out, F.lit(w) * minmax(ce_col, keys) + F.lit(1 - w) * minmax(first_col, keys))


def rerank(hits: DataFrame, k: int, threshold: float | None, keys: Sequence[str], ce_col: str = "ce_score",
           first_rank: str = "rank", out: str = "ce_rank") -> DataFrame:
    """L3 + P12: top-k by re-rank score (ties: first-stage rank), then the inclusive threshold."""
    top = best_n(hits, k, [F.desc(ce_col), F.asc(first_rank)], keys, [first_rank], out)
    return top if threshold is None else top.where(F.col(ce_col) >= F.lit(threshold))
