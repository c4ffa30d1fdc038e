"""Grouped TF-IDF (X1, X2, L4, L5) as one Spark job for every group at once.

Semantics (raw tf, smooth idf, per-document L2 norm after pruning, mean over
all documents of the group):

* tokens (F9), stop words dropped, noun lemma (F10), stop words dropped
  again, terms shorter than 2 letters dropped;
* ``min_df`` = 1 for groups of fewer than 5 documents, else 2;
  ``df <= max_df * N``; a group whose ``max_df * N`` is below ``min_df``
  (one document) yields nothing;
* the vocabulary keeps the ``max_features`` terms with the highest corpus
  frequency (ties: term ascending);
* ``idf = ln((1 + N) / (1 + df)) + 1``; score = mean of the normalised weight.

Plan: one ``explode`` + partial-aggregated ``groupBy(group, doc, token)``
builds the postings (the largest shuffle); the lemma table is computed on the
distinct vocabulary only and joined to the aggregated postings; ``df/cf`` is a
second partial aggregate; the vocabulary cap is a tournament (``relational.top_n``); the
kept-term table is bounded by groups x ``max_features``, so joining it is
cheap; the per-document norm is a window on (group, doc).
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable, Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.arrow_words import plain, words
from kestrel.functions.text import STOP_WORDS, lemma_map, tokens
from kestrel.operators.relational import null_safe_join, top_n
from kestrel.session import cut_lineage, spread

SCORE_DIGITS = 9
#: Rows of counted tokens that a task gives out together.
TOKEN_ROWS = 200_000


def is_stop(c) -> F.Column:
    """Stop-word test; ``isin`` over more than 10 literals is planned as a hash ``InSet``."""
    return c.isin(STOP_WORDS)


def token_rows(docs: DataFrame, group_cols: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """(group..., doc, token) for every pure-letter token."""
    return docs.select(*group_cols, id_col, F.explode(tokens(text_col)).alias("token"))


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct tokens of a corpus: the default lemma lexicon."""
    return docs.select(F.explode(tokens(text_col)).alias("term")).distinct()


def raw_postings(docs: DataFrame, group_cols: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """(group..., doc, token, tf) for every token, stop words included: one tokenisation pass."""
    docs = spread(docs.select(*group_cols, id_col, text_col))
    return (token_rows(docs, list(group_cols), id_col, text_col)
            .groupBy(*group_cols, id_col, "token").agg(F.count(F.lit(1)).alias("tf")))


def raw_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, docs: array of (doc, tf)): a token's rows of an Arrow batch in one row, each (doc, token) in one of them.  Tokens are counted
    within their batch, so nothing is shuffled where ids are unique; rows that share an id are added up."""
    docs = docs.select(id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lens = words(batch.column(1))
            others = batch.column(2)
            coded = pa.concat_arrays([found, others.flatten()]).dictionary_encode()
            rows, place = max(1, len(lens)), np.arange(len(lens))
            of = np.concatenate([np.repeat(place, lens), np.repeat(place, others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            key, n = np.unique(coded.indices.to_numpy().astype(np.int64) * rows + of, return_counts=True)
            starts = np.flatnonzero(np.diff(key // rows, prepend=-1))  # where a token's rows begin
            ends = np.append(starts[1:], len(key))
            cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(key), TOKEN_ROWS)), len(starts)))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                a, z = starts[lo], ends[hi - 1]
                pairs = pa.StructArray.from_arrays([batch.column(0).take(pa.array(key[a:z] % rows)), pa.array(n[a:z].astype(np.int64))], names=[id_col, "tf"])
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key[starts[lo:hi]] // rows)),
                                                  pa.ListArray.from_arrays(pa.array(np.append(starts[lo:hi], z) - a, pa.int32()), pairs)], names=["token", "docs"])

    pair = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("tf", T.LongType())])
    out = T.StructType([T.StructField("token", T.StringType()), T.StructField("docs", T.ArrayType(pair))])
    low = F.lower(F.col(text_col))  # most texts are split as whole batches, the others by ``tokens``
    counted = (spread(docs).withColumn("_plain", plain(low))
               .select(id_col, F.when(F.col("_plain"), F.concat(low, F.lit(" "))).alias("_w"), F.when(~F.col("_plain"), tokens(text_col)).alias("_t"))
               .mapInArrow(count, out))
    if docs.groupBy(id_col).count().where("count > 1").isEmpty():
        return counted
    return one_each(counted.select("token", F.inline("docs")).groupBy(id_col, "token").agg(F.sum("tf").alias("tf")), id_col, "token")


def one_each(rows: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """``rows`` (doc, tf, ``cols``) as blocks of one document."""
    return rows.select(*cols, F.array(F.struct(id_col, "tf")).alias("docs"))


def raw_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, token, tf) as ``raw_postings`` without groups, by ``raw_blocks``."""
    return raw_blocks(docs, id_col, text_col).select("token", F.inline("docs")).select(id_col, "token", "tf")


def block_lexicon(blocks: DataFrame) -> DataFrame:
    """(term, n): the distinct tokens, and how many documents hold them."""
    return blocks.groupBy(F.col("token").alias("term")).agg(F.sum(F.size("docs")).alias("n"))


def shared_terms(lemmas: DataFrame) -> DataFrame:
    """(token, term) of the tokens that may share their term with another one: those with a lemma, and the lemmas themselves."""
    changed = lemmas.select(F.col("term").alias("token"), F.col("lemma").alias("term"))
    own = lemmas.select(F.col("lemma").alias("token")).distinct().join(changed, "token", "left_anti")
    return changed.unionByName(own.withColumn("term", F.col("token")))


def merge_by_term(raw: DataFrame, shared: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``raw`` (doc, token, ...) with ``term`` for ``token``.  Only rows of ``shared`` tokens are given to ``merge``,
    which makes one row per document and term of them; all others are that already and are not moved."""
    alone = raw.join(shared, "token", "left_anti").withColumnRenamed("token", "term")
    return alone.unionByName(merge(raw.join(shared, "token").drop("token")))


def apply_term_rules(raw: DataFrame, group_cols: Sequence[str], id_col: str, lexicon: DataFrame,
                     lemmas: DataFrame | None = None) -> DataFrame:
    """Stop words out, noun lemma (lexicon join on the distinct tokens), stop words out, length >= 2.

    ``lemmas`` (term, lemma) may be passed when already computed for the corpus.
    """
    g = list(group_cols)
    kept = raw.where(~is_stop(F.col("token")))
    lem = lemmas if lemmas is not None else lemma_map(kept.select(F.col("token").alias("term")), "term", lexicon)
    term = F.coalesce(F.col("lemma"), F.col("token"))
    return (kept.join(lem.withColumnRenamed("term", "token"), "token", "left")
            .withColumn("term", term)
            .where(~is_stop(F.col("term")) & (F.length("term") >= 2))
            .groupBy(*g, id_col, "term").agg(F.sum("tf").alias("tf")))


def postings(docs: DataFrame, group_cols: Sequence[str], id_col: str = "doc_id", text_col: str = "text",
             lexicon: DataFrame | None = None, materialize: bool = True) -> DataFrame:
    """(group..., doc, term, tf) after stop words, lemma and length rules.

    The text is tokenised once: the raw (doc, token) counts are written once
    (``materialize``) and both the default lexicon and the term rules read
    them; the ruled postings are written too, since TF-IDF reads them twice
    (document frequencies and weights).  Query-side callers with a handful of
    rows pass ``materialize=False``.
    """
    raw = raw_postings(docs, group_cols, id_col, text_col)
    if materialize:
        raw = cut_lineage(raw)
    lex = lexicon if lexicon is not None else raw.select(F.col("token").alias("term")).distinct()
    out = apply_term_rules(raw, group_cols, id_col, lex)
    return cut_lineage(out) if materialize else out


@dataclass
class TfidfResult:
    terms: DataFrame    # group..., term, df, cf, score  (kept vocabulary)
    summary: DataFrame  # group..., total_unique_terms, total_documents
    group_cols: list

    def top(self, n: int | None) -> DataFrame:
        """L4: top-n terms per group by mean score (desc), term ascending on ties."""
        order = [F.desc(F.round("score", SCORE_DIGITS)), F.asc("term")]
        if n is None:  # all kept terms, which ``max_features`` bounds
            w = Window.partitionBy(*(self.group_cols or [F.lit(0)])).orderBy(*order)
            return self.terms.withColumn("rank", F.row_number().over(w))
        return top_n(self.terms, n, order, self.group_cols, ["term"], "rank")


def tfidf(docs: DataFrame, group_cols: Sequence[str] = (), *, id_col: str = "doc_id", text_col: str = "text",
          max_features: int | None = 1000, max_df: float = 0.8, lexicon: DataFrame | None = None,
          post: DataFrame | None = None) -> TfidfResult:
    """X1 (per group) / X2 (no group columns): kept vocabulary with mean TF-IDF scores."""
    g = list(group_cols)
    if not g:
        docs = docs.withColumn("_g", F.lit(0))
        g = ["_g"]
    p = post if post is not None else postings(docs, g, id_col, text_col, lexicon)
    if "_g" in g and "_g" not in p.columns:
        p = p.withColumn("_g", F.lit(0))
    ndocs = docs.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    min_df = F.when(F.col("n") < 5, F.lit(1)).otherwise(F.lit(2))
    max_cnt = F.lit(max_df) * F.col("n").cast("double")
    stats = (p.groupBy(*g, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
             .transform(lambda s: null_safe_join(s, ndocs, g))  # one row per group, also for a null group
             .where((max_cnt >= min_df) & (F.col("df") >= min_df) & (F.col("df") <= max_cnt)))
    if max_features is not None:
        stats = top_n(stats, max_features, [F.desc("cf"), F.asc("term")], g, ["term"]).drop("_rn")
    stats = stats.withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    weights = (null_safe_join(p, stats.select(*g, "term", "idf", "n"), g + ["term"])
               .withColumn("w", F.col("tf") * F.col("idf")))
    per_doc = Window.partitionBy(*g, id_col)
    weights = weights.withColumn("wn", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_doc)))
    scores = weights.groupBy(*g, "term").agg((F.sum("wn") / F.first("n")).alias("score"))
    terms = null_safe_join(stats.select(*g, "term", "df", "cf"), scores, g + ["term"])
    summary = (null_safe_join(ndocs, stats.groupBy(*g).agg(F.count(F.lit(1)).alias("total_unique_terms")), g, "left")
               .select(*g, F.coalesce("total_unique_terms", F.lit(0)).cast("bigint").alias("total_unique_terms"),
                       F.col("n").alias("total_documents")))
    if g == ["_g"]:
        terms, summary, g = terms.drop("_g"), summary.drop("_g"), []
    return TfidfResult(terms, summary, g)


def corpus_tfidf(lists: DataFrame, n_docs: DataFrame, max_features: int, *, id_col: str = "doc_id", max_df: float = 0.8) -> DataFrame:
    """(term, df, cf, score): ``tfidf`` without groups over a stored corpus (``lists``: term, docs, kept; ``n_docs``: one row n).

    Frequencies are added up block by block, and only blocks of the ``max_features`` kept terms are taken apart.
    """
    kept = lists.where("kept")
    in_block = F.aggregate(F.col("docs.tf"), F.lit(0).cast("long"), lambda a, x: a + x)
    n, max_cnt = F.col("n"), F.lit(max_df) * F.col("n").cast("double")
    min_df = F.when(n < 5, F.lit(1)).otherwise(F.lit(2))
    stats = (kept.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.sum(in_block).alias("cf"))
             .crossJoin(F.broadcast(n_docs.select("n")))  # one-row scalar
             .where((max_cnt >= min_df) & (F.col("df") >= min_df) & (F.col("df") <= max_cnt)))
    stats = top_n(stats, max_features, [F.desc("cf"), F.asc("term")], (), ["term"], "_k")
    # max_features rows, read twice; a term is its number in what is shuffled
    stats = cut_lineage(stats.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1))
    rows = (kept.join(F.broadcast(stats.select("term", "_k", "idf")), "term").select("_k", "idf", F.inline("docs"))
            .select(id_col, "_k", (F.col("tf") * F.col("idf")).alias("w")))
    wn = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    sums = rows.select("_k", wn.alias("wn")).groupBy("_k").agg(F.sum("wn").alias("_s"))
    return stats.join(sums, "_k").select("term", "df", "cf", (F.col("_s") / n).alias("score"))
