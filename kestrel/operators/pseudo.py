"""Pseudo-label construction: best label per document (W4), per-class caps
(W2 by score, W3 seeded random), exact-text dedup (W6), G6 and G9.

Dedup-by-key operators are ``groupBy`` + ``min(struct)``: the partial
aggregate runs map-side, so a key holding a third of all rows costs one row
per map task in the shuffle, not a third of the data in one task.  Caps use
``relational.top_n``, which ranks no class in one task, at any cap.  Ranking and dedup work on ids, scores and
text digests; texts are fetched for the rows that remain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import map_category_to_base, normalize_text, strip_ws
from kestrel.operators.relational import late_rows, top_n


def best_per_id(df: DataFrame, id_col: str | list[str], score_col: str, tie_col: str) -> DataFrame:
    """Keep, per id, the row with the highest score; ties -> smallest ``tie_col``.

    A null score loses to any number (sorts last, as a descending sort would).
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    others = [c for c in df.columns if c not in ids]
    key = F.struct(F.coalesce(-F.col(score_col), F.lit(float("inf"))).alias("_k1"),
                   F.col(tie_col).alias("_k2"),
                   *[F.col(c) for c in others])
    return (df.groupBy(*ids).agg(F.min(key).alias("_b"))
            .select(*ids, *[F.col(f"_b.{c}").alias(c) for c in others]))


def cap_per_class(df: DataFrame, label_col: str, n: int | None, score_col: str, id_col: str) -> DataFrame:
    """Top n rows per class by score (desc), id ascending on ties; None = no cap.

    Ranked on class, score and id alone; the rows' other columns are fetched for the winners only.
    """
    if n is None:
        return df
    order = [F.desc("_score"), F.asc("_id")]
    narrow = [F.col(label_col).alias("_label"), F.col(score_col).alias("_score"), F.col(id_col).alias("_id")]
    return late_rows(df, narrow, lambda d: top_n(d, n, [*order, F.asc("_h1"), F.asc("_h2")], ["_label"], ["_id"]))


def seeded_order(id_col: str, seed: int) -> F.Column:
    """Deterministic pseudo-random order shared with the SQL oracle: md5(seed || ':' || id)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def random_cap_per_class(df: DataFrame, label_col: str, n: int | None, id_col: str, seed: int = 42) -> DataFrame:
    """Seeded random n rows per class, ranked on class and id alone as in ``cap_per_class``."""
    if n is None:
        return df
    order = [seeded_order("_id", seed).asc(), F.asc("_id"), F.asc("_h1"), F.asc("_h2")]
    narrow = [F.col(label_col).alias("_label"), F.col(id_col).alias("_id")]
    return late_rows(df, narrow, lambda d: top_n(d, n, order, ["_label"], ["_id"]))


def first_of_text(df: DataFrame, text_col: str, order_cols: list[str]) -> DataFrame:
    """The rows that ``dedup_text`` keeps, without their text but with its digest ``_text``: text is hashed where it is read and goes no further."""
    others = [c for c in df.columns if c != text_col]
    key = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], *[F.col(c) for c in others])
    return (df.select(*others, F.unhex(F.sha2(text_col, 256)).alias("_text")).groupBy("_text").agg(F.min(key).alias("_b"))
            .select("_text", *[F.col(f"_b.{c}").alias(c) for c in others]))


def dedup_text(df: DataFrame, text_col: str, order_cols: list[str]) -> DataFrame:
    """One row per exact text, keeping the first by ``order_cols``.

    Grouped by a 256-bit digest of the text, which no two texts share; the text rides along once and is never a sort key.
    """
    others = [c for c in df.columns if c != text_col]
    key = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], *[F.col(c) for c in others])
    return (df.groupBy(F.sha2(text_col, 256).alias("_text")).agg(F.min(key).alias("_b"), F.first(text_col).alias(text_col))
            .select(*[F.col(f"_b.{c}").alias(c) for c in others], text_col))


def nonempty_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Strip the text, drop rows whose stripped text is empty or null."""
    return (df.withColumn(text_col, strip_ws(F.coalesce(F.col(text_col), F.lit(""))))
            .where(F.col(text_col) != ""))


def pseudo_labels(hits: DataFrame, cap: int | None = 100, *, id_col: str = "review_id",
                  label_col: str = "label", score_col: str = "ce_score") -> DataFrame:
    """Non-empty text -> best label per document -> per-class top-n by score."""
    kept = nonempty_text(hits)
    narrow = kept.withColumn("_text", F.unhex(F.sha2("text", 256))).drop("text")
    best = best_per_id(narrow, id_col, score_col, label_col)
    return _with_text(cap_per_class(best, label_col, cap, score_col, id_col), kept, id_col).select(*hits.columns)


def _with_text(chosen: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """``chosen`` rows (id, ``_text`` digest) with the text that ``rows`` has for them; only their texts are moved."""
    ids = chosen.select(F.col(id_col).alias("_id"), F.col("_text").alias("_digest"))
    texts = rows.select(F.col(id_col).alias("_id"), F.unhex(F.sha2("text", 256)).alias("_digest"), "text")
    found = texts.join(ids, ["_id", "_digest"], "left_semi").groupBy("_id", "_digest").agg(F.first("text").alias("text"))
    return chosen.join(found, (chosen[id_col] == found["_id"]) & (chosen["_text"] == found["_digest"])).drop("_id", "_digest", "_text")


def dedup_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, after, removed and removed %."""
    b = before.agg(F.count(F.lit(1)).alias("n_before"))
    a = after.agg(F.count(F.lit(1)).alias("n_after"))
    return (b.crossJoin(a)  # two one-row aggregates
            .withColumn("n_removed", F.col("n_before") - F.col("n_after"))
            .withColumn("pct_removed", F.when(F.col("n_before") > 0,
                                              F.round(100.0 * F.col("n_removed") / F.col("n_before"), 1))
                        .otherwise(F.lit(0.0))))


def legacy_training_set(hits: DataFrame, base_labels: list[str], cap: int | None = 2000, seed: int = 42, *,
                        id_col: str = "review_id", category_col: str = "category") -> DataFrame:
    """Category -> base label (F24), strip text, exact-text dedup, seeded cap per class."""
    mapped = map_category_to_base(hits, base_labels, category_col).withColumn("label", F.col("base_label"))
    kept = nonempty_text(mapped.select(id_col, "text", "label"))
    deduped = first_of_text(kept, "text", [id_col, "label"])  # first occurrence: id, then label
    return _with_text(random_cap_per_class(deduped, "label", cap, id_col, seed), kept, id_col).select(id_col, "label", "text")


def legacy_training_split(hits: DataFrame, base_labels: list[str], cap: int | None = 2000, val_frac: float = 0.1, seed: int = 42, *,
                          id_col: str = "review_id", category_col: str = "category") -> DataFrame:
    """G9 to its end: the training set with label ids (J11) and its train / val split."""
    from kestrel.operators.split import tiny_class_split
    from kestrel.session import cut_lineage
    from kestrel.sources.io import label_map
    chosen = cut_lineage(legacy_training_set(hits, base_labels, cap, seed, id_col=id_col, category_col=category_col))
    return tiny_class_split(chosen.join(label_map(chosen), "label"), id_col, "label", val_frac, seed)


__all__ = ["legacy_training_split", "best_per_id", "cap_per_class", "random_cap_per_class", "dedup_text", "nonempty_text",
           "pseudo_labels", "dedup_effect", "legacy_training_set", "seeded_order", "normalize_text"]
