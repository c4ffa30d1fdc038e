"""Checks for TF-IDF: X1 (per language), X2 (global), L4, L5, F9-F11."""

from pyspark.sql import functions as F

from kestrel.operators.tfidf import tfidf
from kestrel.plans.registry import register
from kestrel.plans.sqlparts import RULES_SQL, STOP_SQL, tokens_sql
from kestrel.sources import driver


def tfidf_sql_ctes(docs_cte: str, max_features: int, lexicon: str | None = None, p: str = "") -> str:
    """SQL for grouped TF-IDF over ``{p}docs(grp, doc_id, text)``; defines ``{p}sc(grp, term, df, cf, score)``
    and ``{p}summ(grp, total_unique_terms, total_documents)``.  ``lexicon`` names an existing CTE
    of corpus tokens; by default the tokens of the same documents."""
    lex_def = "" if lexicon else f"{p}lexv AS (SELECT DISTINCT token AS term FROM {p}tok),"
    lex = lexicon or f"{p}lexv"
    return f"""
{docs_cte},
{p}tok AS (SELECT grp, doc_id, unnest({tokens_sql('text')}) AS token FROM {p}docs),
{lex_def}
{p}post0 AS (SELECT grp, doc_id, token, count(*) AS tf FROM {p}tok WHERE NOT list_contains({STOP_SQL}, token) GROUP BY ALL),
{p}vocab AS (SELECT DISTINCT token AS term FROM {p}post0),
{p}lcand AS (
  SELECT v.term, rules.rule, left(v.term, length(v.term) - length(rules.suf)) || rules.rep AS cand
  FROM {p}vocab v CROSS JOIN {RULES_SQL}
  WHERE suffix(v.term, rules.suf) AND length(v.term) > length(rules.suf)
),
{p}lem AS (
  SELECT term, arg_min(cand, length(cand) * 100 + rule) AS lemma FROM {p}lcand
  WHERE length(cand) < length(term) AND cand IN (SELECT term FROM {lex}) GROUP BY term
),
{p}post AS (
  SELECT x.grp, x.doc_id, coalesce(l.lemma, x.token) AS term, sum(x.tf) AS tf
  FROM {p}post0 x LEFT JOIN {p}lem l ON x.token = l.term
  WHERE NOT list_contains({STOP_SQL}, coalesce(l.lemma, x.token)) AND length(coalesce(l.lemma, x.token)) >= 2
  GROUP BY ALL
),
{p}ndocs AS (SELECT grp, count(*) AS n FROM {p}docs GROUP BY grp),
{p}dfs AS (SELECT grp, term, count(*) AS df, sum(tf) AS cf FROM {p}post GROUP BY ALL),
{p}pruned AS (
  SELECT d.*, nd.n FROM {p}dfs d JOIN {p}ndocs nd ON d.grp = nd.grp
  WHERE 0.8::DOUBLE * nd.n >= (CASE WHEN nd.n < 5 THEN 1 ELSE 2 END)
    AND df >= (CASE WHEN nd.n < 5 THEN 1 ELSE 2 END) AND df <= 0.8::DOUBLE * nd.n
),
{p}capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cf DESC, term) AS r FROM {p}pruned)
  WHERE r <= {max_features}
),
{p}wts AS (
  SELECT x.grp, x.doc_id, x.term, c.n, x.tf * (ln((1 + c.n) / (1 + c.df)) + 1) AS w
  FROM {p}post x JOIN {p}capped c ON x.grp = c.grp AND x.term = c.term
),
{p}wn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY grp, doc_id)) AS wn FROM {p}wts),
{p}sc0 AS (SELECT grp, term, sum(wn) / any_value(n) AS score FROM {p}wn GROUP BY grp, term),
{p}sc AS (SELECT c.grp, c.term, c.df, c.cf, s.score FROM {p}capped c JOIN {p}sc0 s ON c.grp = s.grp AND c.term = s.term),
{p}summ AS (
  SELECT nd.grp, coalesce(k.u, 0)::BIGINT AS total_unique_terms, nd.n AS total_documents
  FROM {p}ndocs nd LEFT JOIN (SELECT grp, count(*) AS u FROM {p}capped GROUP BY grp) k ON nd.grp = k.grp
)"""


LANG_DOCS = "docs AS (SELECT lang AS grp, doc_id, text FROM documents)"
ALL_DOCS = "docs AS (SELECT 0 AS grp, doc_id, text FROM documents)"


def _lang_tfidf(spark, sf_dir):
    """Per-language TF-IDF over the corpus postings (tokenised once per corpus; the term
    rules do not depend on the group, so the cached postings are joined to the language)."""
    from kestrel.plans.corpus_cache import corpus_for
    corpus = corpus_for(spark, sf_dir)
    docs = driver.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    post = corpus.index.postings.join(docs.select("doc_id", "lang"), "doc_id")
    return tfidf(docs, ["lang"], max_features=1000, post=post)


@register("tfidf_top_terms", f"""
WITH {tfidf_sql_ctes(LANG_DOCS, 1000)},
top AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, term) AS rank FROM sc)
SELECT grp AS lang, term, df, cf, round(score, 6) AS score, rank::INTEGER AS rank FROM top WHERE rank <= 20
""")
def tfidf_top_terms(spark, sf_dir):
    res = _lang_tfidf(spark, sf_dir)
    return res.top(20).select("lang", "term", "df", "cf", F.round("score", 6).alias("score"), "rank")


@register("tfidf_summary", f"""
WITH {tfidf_sql_ctes(LANG_DOCS, 1000)}
SELECT grp AS lang, total_unique_terms, total_documents FROM summ
""")
def tfidf_summary(spark, sf_dir):
    return _lang_tfidf(spark, sf_dir).summary


@register("global_terms", f"""
WITH {tfidf_sql_ctes(ALL_DOCS, 5000)}
SELECT term, df, cf, round(score, 6) AS score FROM sc
""")
def global_terms(spark, sf_dir):
    """The corpus's global term statistics, computed once per corpus and reused."""
    from kestrel.plans.corpus_cache import corpus_for
    gs = corpus_for(spark, sf_dir).global_scores
    return gs.select("term", "df", "cf", F.round("score", 6).alias("score"))
