"""Checks for query expansion: X1-X5, X9-X12, W11, W12, J9, J10, F12-F16."""

from pyspark.sql import functions as F

from kestrel.operators.beams import merge_beams
from kestrel.operators.expand import (
    assign_distinct_queries, assign_same_query, doc_lemmas, rank_candidates,
)
from kestrel.operators.rerank import bm25, rerank
from kestrel.operators.tfidf import tfidf
from kestrel.plans.registry import register
from kestrel.plans.rerank_plans import BEAM_QUERIES, CE_T, K2, KEYS, RERANKED, beam_query_df, first_stage
from kestrel.plans.sqlparts import BLACKLIST_SQL, RULES_SQL, WS_CLASS, postings_sql, tokens_sql
from kestrel.plans.tfidf_plans import tfidf_sql_ctes
from kestrel.session import cut_lineage
from kestrel.sources import driver

NUM_BEAMS = 3
SEEDS = {c: q for c, b, q in BEAM_QUERIES if b == 1}
ROUND0_BEAMS = [(c, b, SEEDS[c]) for c, b, _ in BEAM_QUERIES]
ROUND_COLS = ["local_tfidf", "local_tfidf_normalized", "global_tfidf", "category_specificity",
              "category_specificity_normalized", "combined_score"]


def _inputs(spark, sf_dir):
    idx, hits = first_stage(spark, sf_dir)
    rr = rerank(bm25(idx, hits, KEYS, "query"), K2, CE_T, KEYS)
    merged = cut_lineage(merge_beams(rr, "union", "doc_id").select("category", "doc_id"))  # few rows of known size: the corpus's texts are not moved
    from kestrel.plans.corpus_cache import corpus_for
    corpus = corpus_for(spark, sf_dir)
    texts = cut_lineage(merged.join(corpus.docs, "doc_id"))
    return idx, texts, corpus.lemma_blocks, corpus.n, corpus.global_scores, corpus.vocab


def _candidates(spark, sf_dir, beams_rows, top_n):
    idx, texts, cl, n, gs, vocab = _inputs(spark, sf_dir)
    beams = spark.createDataFrame(beams_rows, "category string, beam_id int, query string")
    cands = rank_candidates(texts, beams, cl, n, gs, idx.lexicon, top_n=top_n, w_local=0.4, w_spec=0.6, vocab=vocab)
    return beams, cands


def _cand_sql(beam_values: str, top_n: int) -> str:
    return f"""{RERANKED},
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, doc_id ORDER BY ce_score DESC, beam_id) AS r
                     FROM rr) WHERE r = 1),
{tfidf_sql_ctes("l_docs AS (SELECT u.category AS grp, u.doc_id, d.text FROM u JOIN documents d ON u.doc_id = d.doc_id)",
                1000, "lexv", "l_")},
{tfidf_sql_ctes("g_docs AS (SELECT 0 AS grp, doc_id, text FROM documents)", 5000, "lexv", "g_")},
cands AS (
  SELECT * FROM (SELECT grp AS category, term AS word, score AS local_tfidf,
                        row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, term) AS tfidf_rank FROM l_sc)
  WHERE tfidf_rank <= {top_n}
),
bq AS (SELECT * FROM (VALUES {beam_values}) AS v(category, beam_id, query)),
qtoks AS (
  SELECT DISTINCT category, beam_id,
         unnest(list_filter(regexp_split_to_array(lower(query), '{WS_CLASS}+'), lambda t: t <> '')) AS qtok FROM bq
),
qvoc AS (SELECT DISTINCT qtok AS term FROM qtoks),
qlc AS (
  SELECT v.term, rules.rule, left(v.term, length(v.term) - length(rules.suf)) || rules.rep AS cand
  FROM qvoc v CROSS JOIN {RULES_SQL} WHERE suffix(v.term, rules.suf) AND length(v.term) > length(rules.suf)
),
qlem AS (SELECT term, arg_min(cand, length(cand) * 100 + rule) AS lemma FROM qlc
         WHERE length(cand) < length(term) AND cand IN (SELECT term FROM lexv) GROUP BY term),
qforms AS (
  SELECT category, beam_id, qtok AS word FROM qtoks
  UNION SELECT q.category, q.beam_id, coalesce(l.lemma, q.qtok) FROM qtoks q LEFT JOIN qlem l ON q.qtok = l.term
),
filt AS (
  SELECT c.*, b.beam_id, b.query FROM cands c JOIN bq b ON c.category = b.category
  WHERE NOT list_contains({BLACKLIST_SQL}, lower(c.word)) AND length(c.word) >= 3 AND NOT regexp_matches(c.word, '\\d')
    AND NOT EXISTS (SELECT 1 FROM qforms q WHERE q.category = c.category AND q.beam_id = b.beam_id AND q.word = c.word)
),
a_tok AS (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS token FROM documents),
a_voc AS (SELECT DISTINCT token AS term FROM a_tok),
a_lc AS (
  SELECT v.term, rules.rule, left(v.term, length(v.term) - length(rules.suf)) || rules.rep AS cand
  FROM a_voc v CROSS JOIN {RULES_SQL} WHERE suffix(v.term, rules.suf) AND length(v.term) > length(rules.suf)
),
a_lem AS (SELECT term, arg_min(cand, length(cand) * 100 + rule) AS lemma FROM a_lc
          WHERE length(cand) < length(term) AND cand IN (SELECT term FROM lexv) GROUP BY term),
cl AS (SELECT DISTINCT a.doc_id, coalesce(l.lemma, a.token) AS term FROM a_tok a LEFT JOIN a_lem l ON a.token = l.term),
fw AS (SELECT DISTINCT category, word FROM filt),
ldf AS (
  SELECT fw.category, fw.word, count(DISTINCT cl.doc_id) AS ldf
  FROM fw JOIN u ON u.category = fw.category JOIN cl ON cl.doc_id = u.doc_id AND contains(cl.term, fw.word)
  GROUP BY fw.category, fw.word
),
gdf AS (
  SELECT w.word, count(DISTINCT cl.doc_id) AS gdf
  FROM (SELECT DISTINCT word FROM filt) w JOIN cl ON contains(cl.term, w.word) GROUP BY w.word
),
nl AS (SELECT category, count(DISTINCT doc_id) AS nl FROM u GROUP BY category),
ng AS (SELECT count(*) AS ng FROM documents),
sp AS (
  SELECT f.*, coalesce(g.score, 0.0) AS global_tfidf,
         ln(1 + (coalesce(l.ldf, 0) / nl.nl) / (gd.gdf / ng.ng + 0.000001::DOUBLE))
           - (len(string_split(f.word, ' ')) - 1) * 0.5 AS category_specificity
  FROM filt f JOIN nl ON nl.category = f.category
  LEFT JOIN ldf l ON l.category = f.category AND l.word = f.word
  JOIN gdf gd ON gd.word = f.word CROSS JOIN ng
  LEFT JOIN g_sc g ON g.term = f.word
),
mm AS (
  SELECT *, min(local_tfidf) OVER w AS llo, max(local_tfidf) OVER w AS lhi,
         min(category_specificity) OVER w AS slo, max(category_specificity) OVER w AS shi
  FROM sp WINDOW w AS (PARTITION BY category, beam_id)
),
nm AS (
  SELECT *,
    CASE WHEN lhi = llo THEN (CASE WHEN lhi = 0 THEN 0.0 ELSE 0.5 END)
         ELSE least(greatest((local_tfidf - llo) / (lhi - llo), 0.001), 0.999) END AS local_tfidf_normalized,
    CASE WHEN shi = slo THEN (CASE WHEN shi = 0 THEN 0.0 ELSE 0.5 END)
         ELSE least(greatest((category_specificity - slo) / (shi - slo), 0.001), 0.999) END AS category_specificity_normalized
  FROM mm
),
cb AS (SELECT *, 0.4 * local_tfidf_normalized + 0.6 * category_specificity_normalized AS combined_score,
              row_number() OVER (PARTITION BY category, beam_id ORDER BY tfidf_rank) AS rank FROM nm),
cand AS (SELECT *, row_number() OVER (PARTITION BY category, beam_id ORDER BY round(combined_score, 9) DESC, rank) AS final_rank
         FROM cb)"""


_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in ROUND_COLS)
_DIFF_VALUES = ", ".join(f"('{c}', {b}, '{q}')" for c, b, q in BEAM_QUERIES)
_SAME_VALUES = ", ".join(f"('{c}', {b}, '{q}')" for c, b, q in ROUND0_BEAMS)


def _round(df):
    return df.select("category", "beam_id", "word", *[F.round(c, 6).alias(c) for c in ROUND_COLS],
                     "rank", "final_rank")


@register("expansion_candidates", f"""{_cand_sql(_DIFF_VALUES, 30)}
SELECT category, beam_id, word, {_OUT}, rank::INTEGER AS rank, final_rank::INTEGER AS final_rank FROM cand
""")
def expansion_candidates(spark, sf_dir):
    _, cands = _candidates(spark, sf_dir, BEAM_QUERIES, 30)
    return _round(cands)


_FINISH = """
SELECT b.category, b.beam_id, b.query, coalesce(p.word, '') AS suggested_word,
       CASE WHEN coalesce(p.word, '') = '' THEN b.query ELSE b.query || ' ' || p.word END AS expanded_query
FROM bq b LEFT JOIN picks p ON p.category = b.category AND p.beam_id = b.beam_id
"""


@register("beam_words_next", f"""{_cand_sql(_DIFF_VALUES, 30)},
el AS (SELECT * FROM cand WHERE word <> '' AND instr(lower(query), lower(word)) = 0),
p1 AS (SELECT category, beam_id, word FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY final_rank) AS r
        FROM el WHERE beam_id = 1) WHERE r = 1),
p2 AS (SELECT category, beam_id, word FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY final_rank) AS r
        FROM el WHERE beam_id = 2 AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.category = el.category AND lower(p1.word) = lower(el.word)))
      WHERE r = 1),
p3 AS (SELECT category, beam_id, word FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY final_rank) AS r
        FROM el WHERE beam_id = 3
          AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) pp
                          WHERE pp.category = el.category AND lower(pp.word) = lower(el.word)))
      WHERE r = 1),
picks AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
{_FINISH}""")
def beam_words_next(spark, sf_dir):
    beams, cands = _candidates(spark, sf_dir, BEAM_QUERIES, 30)
    return assign_distinct_queries(cands, beams, NUM_BEAMS)


@register("beam_words_round0", f"""{_cand_sql(_SAME_VALUES, 50)},
el AS (SELECT * FROM cand WHERE beam_id = 1 AND word <> '' AND instr(lower(query), lower(word)) = 0),
picks AS (SELECT category, beam_id, word FROM (
  SELECT category, word, row_number() OVER (PARTITION BY category ORDER BY final_rank) AS beam_id FROM el)
  WHERE beam_id <= {NUM_BEAMS})
{_FINISH}""")
def beam_words_round0(spark, sf_dir):
    beams, cands = _candidates(spark, sf_dir, ROUND0_BEAMS, 50)
    return assign_same_query(cands, beams)


# Three-way score with the pair scorer over each category's top 20 first-stage documents
N_PAIR_DOCS = 20
_BM = ("ln(1 + (nd.n - i.df + 0.5::DOUBLE) / (i.df + 0.5::DOUBLE)) * dw.tf * 2.2::DOUBLE"
       " / (dw.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl.dl / avgdl.avgdl))")


@register("expansion_three_way", f"""{_cand_sql(_DIFF_VALUES, 30)},
xq AS (SELECT category || '|' || beam_id::VARCHAR || '|' || word AS xid, category, beam_id, word,
              query || ' ' || word AS xquery FROM cand),
{postings_sql('x_', 'xq', 'xid', 'xquery', 'lexv')},
top20 AS (SELECT category, doc_id FROM (
  SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY min(rank), doc_id) AS place FROM hits GROUP BY category, doc_id)
  WHERE place <= {N_PAIR_DOCS}),
xp AS (SELECT x.xid, t.doc_id FROM xq x JOIN top20 t ON t.category = x.category),
xt AS (SELECT DISTINCT pid AS xid, term FROM x_post),
bmx AS (
  SELECT xp.xid, xp.doc_id, sum({_BM}) AS s
  FROM xp JOIN xt ON xt.xid = xp.xid JOIN dw ON dw.doc_id = xp.doc_id AND dw.term = xt.term
  JOIN dl ON dl.doc_id = xp.doc_id JOIN idf i ON i.term = xt.term CROSS JOIN nd CROSS JOIN avgdl
  GROUP BY xp.xid, xp.doc_id
),
ps AS (
  SELECT xp.xid, avg(round(coalesce(b.s, 0.0), 9)) AS pair_score
  FROM xp LEFT JOIN bmx b ON b.xid = xp.xid AND b.doc_id = xp.doc_id GROUP BY xp.xid
),
c3 AS (SELECT c.*, coalesce(ps.pair_score, 0.0) AS pair_score FROM cand c JOIN xq ON xq.category = c.category
       AND xq.beam_id = c.beam_id AND xq.word = c.word LEFT JOIN ps ON ps.xid = xq.xid),
m3 AS (SELECT *, min(pair_score) OVER (PARTITION BY category, beam_id) AS plo,
              max(pair_score) OVER (PARTITION BY category, beam_id) AS phi FROM c3),
n3 AS (SELECT *, CASE WHEN phi = plo THEN (CASE WHEN phi = 0 THEN 0.0 ELSE 0.5 END)
                      ELSE least(greatest((pair_score - plo) / (phi - plo), 0.001), 0.999) END AS pn FROM m3),
k3 AS (SELECT *, 0.3 * local_tfidf_normalized + 0.5 * pn + 0.2 * category_specificity_normalized AS combined3 FROM n3)
SELECT category, beam_id, word, round(pair_score, 6) AS pair_score, round(combined3, 6) AS combined_score,
       row_number() OVER (PARTITION BY category, beam_id ORDER BY round(combined3, 9) DESC, rank)::INTEGER AS final_rank
FROM k3
""")
def expansion_three_way(spark, sf_dir):
    from kestrel.operators.expand import pair_score_term, three_way_scores
    idx, hits = first_stage(spark, sf_dir)
    _, cands = _candidates(spark, sf_dir, BEAM_QUERIES, 30)
    pair = pair_score_term(idx, cands, hits, N_PAIR_DOCS)
    out = three_way_scores(cands, pair, 0.3, 0.5, 0.2)
    return out.select("category", "beam_id", "word", F.round("pair_score", 6).alias("pair_score"),
                      F.round("combined_score", 6).alias("combined_score"), "final_rank")
