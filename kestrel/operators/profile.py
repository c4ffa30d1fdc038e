"""Text length profile (G12): A4-A10, F8, F27, M10.

One pass per statistic family, all aggregates JVM-side.  Exact percentiles use
Spark's ``percentile`` whose buffer is a value->count map, so its memory grows
with the number of *distinct* lengths (bounded by the longest text), not with
rows.  The per-model over-limit figures are conditional aggregates in a single
pass, then unpivoted with ``stack``; no data x limits product is formed.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import tokens
from kestrel.session import spread

# Bin edges and labels of the character and token histograms,
# the reported percentiles, and the model sequence limits of the profile.
CHAR_EDGES = [0, 250, 500, 750, 1000, 1500, 2000, 3000, 10000]
CHAR_LABELS = ["0-250", "250-500", "500-750", "750-1000", "1000-1500", "1500-2000", "2000-3000", "3000+"]
TOKEN_EDGES = [0, 64, 128, 256, 384, 512, 768, 1024, 10000]
TOKEN_LABELS = ["0-64", "64-128", "128-256", "256-384", "384-512", "512-768", "768-1024", "1024+"]
PERCENTILES = [25, 50, 75, 90, 95, 99]
MODEL_LIMITS = [
    ("all-MiniLM-L6-v2", 256),
    ("all-mpnet-base-v2", 384),
    ("bge-base-en-v1.5", 512),
    ("distilbert", 512),
]
SPECIAL_TOKENS = 2  # a sequence start and end marker are added to every encoded text


def default_token_count(text_col) -> Column:
    """M10 stand-in: pure-letter word tokens (F9) plus the two special tokens.

    Sub-word tokenizers need model files; pass ``token_counter`` (e.g. an
    Arrow ``pandas_udf`` around a local tokenizer) to :func:`with_token_length`
    to use one.
    """
    return (F.size(tokens(text_col)) + F.lit(SPECIAL_TOKENS)).cast("int")


def with_token_length(df: DataFrame, text_col: str = "text", out: str = "token_length",
                      token_counter: Callable[[Column], Column] | None = None) -> DataFrame:
    counter = token_counter or default_token_count
    return spread(df).withColumn(out, counter(F.col(text_col)))


def length_stats(df: DataFrame, col: str, std: str = "samp") -> DataFrame:
    """N, mean, median, std (sample or population), min, max and percentiles."""
    x = F.col(col).cast("double")
    sd = F.stddev_samp(x) if std == "samp" else F.stddev_pop(x)
    # one buffer for all percentiles
    shares = F.array(*[F.lit(p / 100.0) for p in [50, *PERCENTILES]])
    out = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), sd.alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                 F.percentile(x, shares).alias("_p"))
    return out.select("n", "mean", F.col("_p")[0].alias("median"), "std", "min", "max",
                      *[F.col("_p")[i + 1].alias(f"p{p}") for i, p in enumerate(PERCENTILES)])


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins (lo, hi]; values outside every bin get null."""
    expr = None
    for i in range(len(edges) - 1):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def length_histogram(df: DataFrame, col: str, edges: Sequence[float] = CHAR_EDGES,
                     labels: Sequence[str] = CHAR_LABELS, max_tokens: int | None = None) -> DataFrame:
    """Counts per right-closed bin, zero-filled; % over *all* rows.

    Rows outside the edges (e.g. length 0 or above the last edge) fall in no
    bin but stay in the denominator.  With ``max_tokens`` a ``fits`` flag
    (bin upper edge <= limit) is added.
    """
    spark = df.sparkSession
    whole = Window.partitionBy()  # only over the <= len(edges) grouped rows
    counts = (df.select(bin_index(F.col(col), edges).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("total", F.sum("n").over(whole)))
    bins = spark.createDataFrame(
        [(i, labels[i], float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)],
        "bin int, label string, lo double, hi double")
    out = (bins.join(counts, "bin", "full")
           .withColumn("total", F.max("total").over(whole))
           .where(F.col("label").isNotNull())
           .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint")))
    if_total = F.coalesce(F.col("total"), F.lit(0))
    out = out.withColumn("pct", F.when(if_total > 0, F.round(100.0 * F.col("n") / if_total, 1)).otherwise(0.0))
    cols = ["bin", "label", "lo", "hi", "n", "pct"]
    if max_tokens is not None:
        out = out.withColumn("fits", F.col("hi") <= F.lit(float(max_tokens)))
        cols.append("fits")
    return out.select(*cols)


def over_limit(df: DataFrame, col: str, limits: Sequence[tuple[str, int]] = MODEL_LIMITS) -> DataFrame:
    """Per model limit, rows over it, %, mean/max tokens lost, loss % of mean over-length, coverage."""
    x = F.col(col)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (_, lim) in enumerate(limits):
        over = x > F.lit(lim)
        aggs += [F.count_if(over).alias(f"o{i}"),
                 F.avg(F.when(over, x - F.lit(lim))).alias(f"l{i}"),
                 F.max(F.when(over, x - F.lit(lim))).alias(f"m{i}"),
                 F.avg(F.when(over, x)).alias(f"a{i}")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{name}', {lim}, o{i}, l{i}, m{i}, a{i}" for i, (name, lim) in enumerate(limits))
    long = one.selectExpr("n", f"stack({len(limits)}, {stack}) AS (model, max_tokens, n_over, avg_loss, max_loss, avg_over_len)")
    pct = F.when(F.col("n") > 0, 100.0 * F.col("n_over") / F.col("n")).otherwise(0.0)
    return (long.withColumn("pct_over", pct)
            .withColumn("avg_loss_pct", F.when(F.col("avg_over_len") > 0,
                                               100.0 * F.col("avg_loss") / F.col("avg_over_len")))
            .withColumn("coverage", 100.0 - F.col("pct_over"))
            .withColumn("advice", advice_band(F.col("pct_over")))
            .select("model", F.col("max_tokens").cast("int").alias("max_tokens"), "n",
                    F.col("n_over").cast("bigint").alias("n_over"), "pct_over", "avg_loss", "avg_loss_pct",
                    F.col("max_loss").cast("int").alias("max_loss"), "coverage", "advice"))


def advice_band(pct_over: Column) -> Column:
    """A10: three advice bands on the share of truncated texts (> 30 %, > 15 %, else)."""
    return (F.when(pct_over > 30, F.lit("high truncation: chunk texts or use a longer-context model"))
            .when(pct_over > 15, F.lit("moderate truncation: consider chunking long texts"))
            .otherwise(F.lit("low truncation: current limit is adequate")))


def prefix_share(df: DataFrame, col: str, prefix: str = "Business:") -> DataFrame:
    """F8: rows whose text starts with ``prefix`` and their share of all rows."""
    return df.agg(F.count_if(F.col(col).startswith(prefix)).alias("n_prefixed"),
                  F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.when(F.col("n") > 0, F.col("n_prefixed") / F.col("n")).otherwise(0.0))
