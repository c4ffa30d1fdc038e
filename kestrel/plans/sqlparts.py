"""DuckDB SQL fragments shared by the oracle texts.

These are independent re-statements of the operator semantics in SQL; the
oracle never calls Spark.  DuckDB lambdas use the ``lambda x: ...`` form.
"""

from kestrel.functions.text import GENERIC_BLACKLIST, LEMMA_RULES, STOP_WORDS, WS_CLASS


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Unit vectors of `embeddings` and per-label centroid queries.
VEC_CTES = """
v0 AS (
  SELECT vec_id AS id, label::INTEGER AS label, embedding::DOUBLE[] AS e,
         sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nrm
  FROM embeddings
), vn AS (
  SELECT id, label, list_transform(e, lambda x: CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END) AS e FROM v0
), cparts AS (
  SELECT label, pos, avg(x) AS m
  FROM (SELECT label, unnest(generate_series(1, len(e))) AS pos, unnest(e) AS x FROM vn)
  GROUP BY label, pos
), cm AS (
  SELECT label, list(m ORDER BY pos) AS q FROM cparts GROUP BY label
), cm2 AS (
  SELECT label, q, sqrt(list_sum(list_transform(q, lambda x: x * x))) AS nrm FROM cm
), cq AS (
  SELECT 'label_' || label::VARCHAR AS category, label,
         list_transform(q, lambda x: CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END) AS q
  FROM cm2
)"""


def topk_hits_cte(k: int, t: float) -> str:
    """Centroid queries x vectors, top-k per category, then the inclusive threshold."""
    return VEC_CTES + f""",
scored AS (
  SELECT cq.category, vn.id, round(list_dot_product(vn.e, cq.q), 9) AS score
  FROM vn CROSS JOIN cq
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS rank FROM scored
), hits AS (
  SELECT category, id, score, rank FROM ranked WHERE rank <= {k} AND score >= {t}
)"""


# Tokeniser (F9) in SQL, by its own route: a comma or colon before a digit is hidden, every mark becomes a
# blank, the joined words are written out, and each piece is trimmed step by step.
def tokens_sql(expr: str) -> str:
    x = f"regexp_replace(regexp_replace(lower({expr}), ',([0-9])', chr(1) || '\\1', 'g'), ':([0-9])', chr(2) || '\\1', 'g')"
    for mark in [";", "@", "#", "$", "%", "&", "?", "!", "*", "[", "]", "(", ")", "{", "}", "<", ">", '"', "`", "\u00ab", "\u00bb",
                 "\u2018", "\u2019", "\u201c", "\u201d", "\u201e", ",", ":", "--"]:
        x = f"replace({x}, '{mark}', ' ')"
    x = f"replace(replace(regexp_replace({x}, '[.][.]+', ' ', 'g'), chr(1), ','), chr(2), ':')"
    for word, a, b in [("cannot", "can", "not"), ("gimme", "gim", "me"), ("lemme", "lem", "me"), ("gonna", "gon", "na"),
                       ("wanna", "wan", "na"), ("gotta", "got", "ta")]:
        x = f"regexp_replace({x}, '\\b{word}\\b', '{a} {b}', 'g')"
    piece = "regexp_replace(regexp_replace(regexp_replace(t, '[.]$', ''), '^''+|''+$', '', 'g'), '(n''t|''(s|m|d|ll|re|ve))$', '')"
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '{WS_CLASS}+'), lambda t: {piece}), "
            r"lambda t: regexp_full_match(t, '\p{L}+'))")


def clean_sql(expr: str) -> str:
    return (f"coalesce(regexp_replace(regexp_replace({expr}, '{WS_CLASS}+', ' ', 'g'), "
            f"'^ | $', '', 'g'), '')")


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


STOP_SQL = sql_list(STOP_WORDS)
BLACKLIST_SQL = sql_list(GENERIC_BLACKLIST)
RULES_SQL = "(VALUES " + ", ".join(
    f"({i}, '{s}', '{r}')" for i, (s, r) in enumerate(LEMMA_RULES)) + ") AS rules(rule, suf, rep)"


def postings_sql(p: str, src: str, id_expr: str, text_expr: str, lexicon: str) -> str:
    """CTEs ``{p}post(pid, term, tf)``: tokens -> stop words -> lemma (lexicon) -> stop words, length >= 2."""
    return f"""
{p}tok AS (SELECT {id_expr} AS pid, unnest({tokens_sql(text_expr)}) AS token FROM {src}),
{p}post0 AS (SELECT pid, token, count(*) AS tf FROM {p}tok WHERE NOT list_contains({STOP_SQL}, token) GROUP BY ALL),
{p}voc AS (SELECT DISTINCT token AS term FROM {p}post0),
{p}lcand AS (
  SELECT v.term, rules.rule, left(v.term, length(v.term) - length(rules.suf)) || rules.rep AS cand
  FROM {p}voc v CROSS JOIN {RULES_SQL}
  WHERE suffix(v.term, rules.suf) AND length(v.term) > length(rules.suf)
),
{p}lem AS (
  SELECT term, arg_min(cand, length(cand) * 100 + rule) AS lemma FROM {p}lcand
  WHERE length(cand) < length(term) AND cand IN (SELECT term FROM {lexicon}) GROUP BY term
),
{p}post AS (
  SELECT x.pid, coalesce(l.lemma, x.token) AS term, sum(x.tf) AS tf
  FROM {p}post0 x LEFT JOIN {p}lem l ON x.token = l.term
  WHERE NOT list_contains({STOP_SQL}, coalesce(l.lemma, x.token)) AND length(coalesce(l.lemma, x.token)) >= 2
  GROUP BY ALL
)"""


def sparse_index_sql(src: str = "documents") -> str:
    """Corpus TF-IDF index: lexv, d_post, nd(n), dl(doc_id, dl), avgdl, idf(term, df, idf), dw(doc_id, term, tf, weight)."""
    return f"""
lexv AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM {src}),
{postings_sql('d_', src, 'doc_id', 'text', 'lexv')},
nd AS (SELECT count(*) AS n FROM {src}),
dl AS (SELECT pid AS doc_id, sum(tf) AS dl FROM d_post GROUP BY pid),
avgdl AS (SELECT sum(dl) / (SELECT n FROM nd) AS avgdl FROM dl),
idf AS (SELECT term, count(*) AS df, ln((1 + any_value(nd.n)) / (1 + count(*))) + 1 AS idf FROM d_post, nd GROUP BY term),
dw0 AS (SELECT x.pid AS doc_id, x.term, x.tf, x.tf * i.idf AS w FROM d_post x JOIN idf i ON x.term = i.term),
dw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM dw0)"""


def retrieve_sql(queries_values: str, k: int) -> str:
    """Sparse top-k for ``qv(category, beam_id, query)``; defines q_src, q_post, hits."""
    return f"""
qv AS (SELECT * FROM (VALUES {queries_values}) AS v(category, beam_id, query)),
q_src AS (SELECT category || '|' || beam_id::VARCHAR AS pid, category, beam_id, query FROM qv),
{postings_sql('q_', 'q_src', 'pid', 'query', 'lexv')},
qw0 AS (SELECT x.pid, x.term, x.tf * i.idf AS w FROM q_post x JOIN idf i ON x.term = i.term),
qw AS (SELECT pid, term, w / sqrt(sum(w * w) OVER (PARTITION BY pid)) AS qweight FROM qw0),
sc AS (SELECT qw.pid, dw.doc_id, round(sum(dw.weight * qw.qweight), 9) AS score
       FROM qw JOIN dw ON qw.term = dw.term GROUP BY qw.pid, dw.doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, doc_id) AS rank FROM sc),
hits AS (
  SELECT s.pid, s.category, s.beam_id, s.query, rk.doc_id, rk.score, rk.rank
  FROM rk JOIN q_src s ON rk.pid = s.pid WHERE rk.rank <= {k}
)"""


def bm25_sql(hits: str = "hits") -> str:
    """BM25 (k1 1.2, b 0.75) of each hit; defines ``ce`` = hits + ce_score."""
    return f"""
hq AS (SELECT DISTINCT pid, term FROM q_post),
bm AS (
  SELECT h.pid, h.doc_id,
         sum(ln(1 + (nd.n - i.df + 0.5::DOUBLE) / (i.df + 0.5::DOUBLE)) * dw.tf * 2.2::DOUBLE
             / (dw.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl.dl / avgdl.avgdl))) AS s
  FROM {hits} h JOIN hq ON h.pid = hq.pid
  JOIN dw ON dw.doc_id = h.doc_id AND dw.term = hq.term
  JOIN dl ON dl.doc_id = h.doc_id JOIN idf i ON i.term = hq.term
  CROSS JOIN nd CROSS JOIN avgdl
  GROUP BY h.pid, h.doc_id
),
ce AS (SELECT h.*, round(coalesce(bm.s, 0.0), 9) AS ce_score FROM {hits} h LEFT JOIN bm ON h.pid = bm.pid AND h.doc_id = bm.doc_id)"""
