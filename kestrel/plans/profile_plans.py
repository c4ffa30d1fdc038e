"""Checks for the length profile: A4-A10, F27, M10 over all documents."""

from pyspark.sql import functions as F

from kestrel.operators.profile import (
    CHAR_EDGES, CHAR_LABELS, MODEL_LIMITS, PERCENTILES, SPECIAL_TOKENS, TOKEN_EDGES, TOKEN_LABELS,
    default_token_count, length_histogram, length_stats, over_limit,
)
from kestrel.plans.registry import register
from kestrel.plans.sqlparts import tokens_sql
from kestrel.session import spread
from kestrel.sources import driver

DOC_LEN_CTE = f"""
d AS (SELECT length(text)::DOUBLE AS c, (len({tokens_sql('text')}) + {SPECIAL_TOKENS})::DOUBLE AS t FROM documents)"""


def _docs(spark, sf_dir):
    docs = spread(driver.table(spark, sf_dir, "documents").select("text"))
    return docs.select(F.length("text").alias("c"), default_token_count(F.col("text")).alias("t"))


def _stats_sql(measure, col, std):
    pcts = ", ".join(f"round(quantile_cont({col}, {p / 100.0}), 6) AS p{p}" for p in PERCENTILES)
    return (f"SELECT '{measure}' AS measure, count({col}) AS n, round(avg({col}), 6) AS mean, "
            f"round(quantile_cont({col}, 0.5), 6) AS median, round(stddev_{std}({col}), 6) AS std, "
            f"round(min({col}), 6) AS min, round(max({col}), 6) AS max, {pcts} FROM d")


@register("length_stats", f"""
WITH {DOC_LEN_CTE}
{_stats_sql('chars', 'c', 'samp')}
UNION ALL
{_stats_sql('tokens', 't', 'pop')}
""")
def length_stats_check(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    a = length_stats(docs, "c", "samp").withColumn("measure", F.lit("chars"))
    b = length_stats(docs, "t", "pop").withColumn("measure", F.lit("tokens"))
    out = a.unionByName(b)
    return out.select("measure", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("measure", "n")])


def _hist_sql(col, edges, labels, max_tokens=None):
    values = ", ".join(f"({i}, '{labels[i]}', {float(edges[i])}, {float(edges[i + 1])})"
                       for i in range(len(edges) - 1))
    fits = f", b.hi <= {float(max_tokens)} AS fits" if max_tokens is not None else ""
    return f"""
WITH {DOC_LEN_CTE},
bins AS (SELECT * FROM (VALUES {values}) AS v(bin, label, lo, hi)),
tot AS (SELECT count(*) AS total FROM d),
c AS (SELECT b.bin, count(d.{col}) AS n FROM bins b LEFT JOIN d ON d.{col} > b.lo AND d.{col} <= b.hi GROUP BY b.bin)
SELECT b.bin::INTEGER AS bin, b.label, b.lo::DOUBLE AS lo, b.hi::DOUBLE AS hi, c.n,
       CASE WHEN total > 0 THEN round(100.0::DOUBLE * c.n / total, 1) ELSE 0.0 END AS pct{fits}
FROM bins b JOIN c ON b.bin = c.bin CROSS JOIN tot
"""


@register("length_histogram", _hist_sql("c", CHAR_EDGES, CHAR_LABELS))
def length_histogram_check(spark, sf_dir):
    return length_histogram(_docs(spark, sf_dir), "c", CHAR_EDGES, CHAR_LABELS)


@register("token_histogram", _hist_sql("t", TOKEN_EDGES, TOKEN_LABELS, 256))
def token_histogram_check(spark, sf_dir):
    return length_histogram(_docs(spark, sf_dir), "t", TOKEN_EDGES, TOKEN_LABELS, max_tokens=256)


_LIMITS_SQL = ", ".join(f"('{m}', {n})" for m, n in MODEL_LIMITS)


@register("over_limit", f"""
WITH {DOC_LEN_CTE},
lim AS (SELECT * FROM (VALUES {_LIMITS_SQL}) AS v(model, max_tokens)),
a AS (
  SELECT model, max_tokens, count(*) AS n, count_if(t > max_tokens) AS n_over,
         avg(CASE WHEN t > max_tokens THEN t - max_tokens END) AS avg_loss,
         max(CASE WHEN t > max_tokens THEN t - max_tokens END) AS max_loss,
         avg(CASE WHEN t > max_tokens THEN t END) AS avg_over_len
  FROM lim CROSS JOIN d GROUP BY model, max_tokens
)
SELECT model, max_tokens::INTEGER AS max_tokens, n, n_over,
       round(100.0::DOUBLE * n_over / n, 6) AS pct_over, round(avg_loss, 6) AS avg_loss,
       round(100.0::DOUBLE * avg_loss / avg_over_len, 6) AS avg_loss_pct, max_loss::INTEGER AS max_loss,
       round(100.0 - 100.0::DOUBLE * n_over / n, 6) AS coverage,
       CASE WHEN 100.0 * n_over / n > 30 THEN 'high truncation: chunk texts or use a longer-context model'
            WHEN 100.0 * n_over / n > 15 THEN 'moderate truncation: consider chunking long texts'
            ELSE 'low truncation: current limit is adequate' END AS advice
FROM a
""")
def over_limit_check(spark, sf_dir):
    out = over_limit(_docs(spark, sf_dir), "t")
    r = ["pct_over", "avg_loss", "avg_loss_pct", "coverage"]
    return out.select(*[F.round(c, 6).alias(c) if c in r else F.col(c) for c in out.columns])
