"""Preparation of businesses and reviews.

All steps are lazy DataFrame transformations; the semi join runs before the
text cleaning so Catalyst can push it under the projection (the reference's
hand "filter first" becomes plan order).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import clean_text, first_or_null, parse_categories, prefix_name, size_or_zero
from kestrel.operators.pseudo import seeded_order
from kestrel.operators.relational import top_n
from kestrel.session import spread

BASE_COLS = ["business_id", "name", "city", "state", "stars", "review_count", "categories",
             "categories_list", "category_count"]


def with_categories(businesses: DataFrame) -> DataFrame:
    """F1 + size: ``categories_list`` and ``category_count``."""
    return (businesses.withColumn("categories_list", parse_categories("categories"))
            .withColumn("category_count", size_or_zero("categories_list")))


def single_target(businesses: DataFrame, targets: Sequence[str], max_categories: int | None = None,
                  filter_by_target: bool = True) -> DataFrame:
    """G1: businesses with at least one category and exactly one target category.

    A target that appears twice in the list counts twice (ambiguous), as the
    reference keeps duplicates.  ``max_categories`` bounds ``category_count``.
    """
    df = with_categories(businesses).where(F.col("category_count") > 0)  # P7
    cols = list(BASE_COLS)
    if filter_by_target:
        tset = F.array(*[F.lit(t) for t in targets])
        df = (df.where(F.exists("categories_list", lambda x: F.array_contains(tset, x)))  # P8
              .withColumn("target_categories",
                          F.filter("categories_list", lambda x: F.array_contains(tset, x)))
              .withColumn("target_category_count", size_or_zero("target_categories"))
              .where(F.col("target_category_count") == 1))  # P9
        cols += ["target_categories", "target_category_count"]
    if max_categories is not None:
        df = df.where(F.col("category_count") <= max_categories)  # P10
    return df.select(*cols)


def category_stats(businesses: DataFrame) -> DataFrame:
    """A1: per category, business count (rows), mean stars, total reviews; most businesses first."""
    if "categories_list" not in businesses.columns:
        businesses = with_categories(businesses)
    exploded = businesses.select("business_id", "stars", "review_count",
                                 F.explode("categories_list").alias("category"))
    return (exploded.groupBy("category")
            .agg(F.count("business_id").alias("business_count"),
                 F.avg("stars").alias("avg_stars"),
                 F.coalesce(F.sum("review_count"), F.lit(0)).cast("bigint").alias("total_reviews"))
            .orderBy(F.desc("business_count"), F.asc("category")))


def sample_exact(df: DataFrame, id_col: str, n: int | None, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all when n is None or >= count), deterministic md5 order."""
    if n is None:
        return df
    return top_n(df, n, [seeded_order(id_col, seed).asc(), F.asc(id_col)], spread_by=[id_col]).drop("_rn")


def prepare_reviews(reviews: DataFrame, businesses: DataFrame | None = None, *,
                    business_ids: DataFrame | None = None, min_len: int = 25, max_len: int | None = None,
                    min_stars: float | None = None, max_stars: float | None = None,
                    min_useful: int | None = None, sample_size: int | None = None, seed: int = 42,
                    id_col: str = "review_id") -> DataFrame:
    """Semi join -> clean -> length/stars/useful filters -> sample -> label join -> name prefix."""
    df = reviews
    if business_ids is not None:  # J1
        df = df.join(business_ids.select("business_id").distinct(), "business_id", "left_semi")
    df = spread(df)  # regex cleaning is CPU-heavy: make sure it has enough tasks
    df = df.withColumn("text", clean_text("text")).withColumn("text_length", F.length("text"))
    df = df.where(F.col("text_length") >= min_len)  # P4
    if max_len:
        df = df.where(F.col("text_length") <= max_len)
    if min_stars is not None:  # P5
        df = df.where(F.col("stars") >= min_stars)
    if max_stars is not None:
        df = df.where(F.col("stars") <= max_stars)
    if min_useful is not None:  # P6
        df = df.where(F.col("useful") >= min_useful)
    df = sample_exact(df, id_col, sample_size, seed)  # L6, before the label join
    if businesses is not None and "target_categories" in businesses.columns:  # J2
        lab = businesses.select("business_id", "target_categories", "name")
        df = (df.join(lab, "business_id", "inner")
              .withColumn("label", first_or_null("target_categories"))
              .withColumn("label_count", size_or_zero("target_categories"))
              .drop("target_categories")
              .withColumn("text", prefix_name("name", "text"))
              .withColumn("text_length", F.length("text")))
    return df


def null_label_count(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A3: number of rows without a label."""
    return df.agg(F.count_if(F.col(label_col).isNull()).alias("null_labels"))


def value_counts(df: DataFrame, col: str, by_key: bool = False) -> DataFrame:
    """A2: rows per value, most frequent first (or by key)."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.asc(col)) if by_key else out.orderBy(F.desc("n"), F.asc(col))


def join_reviews(reviews: DataFrame, businesses: DataFrame, max_per_business: int | None = None,
                 order_cols: Sequence[str] = ("date", "review_id")) -> DataFrame:
    """J3 + P2 + W1: review x business wide table, optional first n reviews per business."""
    if "categories_list" not in businesses.columns:
        businesses = with_categories(businesses)
    biz = businesses.select("business_id", "name", "city", "state",
                            F.col("stars").alias("business_stars"), "categories", "categories_list")
    joined = reviews.join(biz, "business_id", "inner")
    if max_per_business:
        w = Window.partitionBy("business_id").orderBy(*[F.col(c) for c in order_cols])
        joined = (joined.withColumn("_rn", F.row_number().over(w))
                  .where(F.col("_rn") <= max_per_business).drop("_rn"))
    if "text" in joined.columns:
        joined = joined.withColumn("text_length", F.length("text"))
    return joined
