"""Checks for preparation: F1, P7-P10, A1, J1-J3, F2, F4-F6, P4, W1."""

from pyspark.sql import functions as F

from kestrel.operators.prepare import category_stats, join_reviews, prepare_reviews, single_target
from kestrel.plans.registry import register
from kestrel.plans.sqlparts import clean_sql, sql_list, strip_sql
from kestrel.sources import driver

TARGETS = driver.TARGET_CATEGORIES

BIZ_CTE = f"""
b AS (
  SELECT p_partkey AS business_id, p_name AS name, p_brand AS city, p_type AS state,
         p_size / 10.0::DOUBLE AS stars, p_size::BIGINT AS review_count,
         concat_ws(', ', p_type, string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]) AS categories
  FROM part
), bc AS (
  SELECT *, CASE WHEN categories IS NULL OR categories = '' THEN []::VARCHAR[]
                 ELSE list_transform(string_split(categories, ','), lambda x: {strip_sql('x')}) END AS categories_list
  FROM b
), bt AS (
  SELECT *, len(categories_list)::INTEGER AS category_count,
         list_filter(categories_list, lambda x: list_contains({sql_list(TARGETS)}, x)) AS target_categories
  FROM bc
), single AS (
  SELECT *, len(target_categories)::INTEGER AS target_category_count FROM bt
  WHERE category_count > 0 AND len(target_categories) = 1
)"""

REVIEWS_CTE = """
r AS (
  SELECT d.doc_id AS review_id, d.doc_id AS business_id, d.source AS user_id,
         l.quality::DOUBLE AS stars, coalesce(l.toxic, 0)::BIGINT AS useful, d.text, d.lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def _businesses(spark, sf_dir):
    return driver.businesses(spark, sf_dir)


@register("single_target_parts", f"""
WITH {BIZ_CTE}
SELECT business_id, name, categories, category_count, target_categories[1] AS label, target_category_count
FROM single
""")
def single_target_parts(spark, sf_dir):
    g1 = single_target(_businesses(spark, sf_dir), TARGETS)
    return g1.select("business_id", "name", "categories", "category_count",
                     F.get("target_categories", 0).alias("label"), "target_category_count")


@register("category_stats", f"""
WITH {BIZ_CTE}, e AS (SELECT business_id, stars, review_count, unnest(categories_list) AS category FROM bc)
SELECT category, count(business_id) AS business_count, round(avg(stars), 6) AS avg_stars,
       coalesce(sum(review_count), 0)::BIGINT AS total_reviews
FROM e GROUP BY category
""")
def category_stats_check(spark, sf_dir):
    s = category_stats(_businesses(spark, sf_dir))
    return s.select("category", "business_count", F.round("avg_stars", 6).alias("avg_stars"), "total_reviews")


@register("labelled_reviews", f"""
WITH {BIZ_CTE}, {REVIEWS_CTE},
sj AS (SELECT * FROM r WHERE business_id IN (SELECT business_id FROM single)),
cl AS (SELECT review_id, business_id, stars, {clean_sql("text")} AS text FROM sj),
f AS (SELECT *, length(text) AS n FROM cl WHERE length(text) >= 25),
j AS (
  SELECT f.review_id, f.business_id, f.stars, s.target_categories[1] AS label,
         len(s.target_categories)::INTEGER AS label_count, s.name || '. ' || f.text AS text
  FROM f JOIN single s ON f.business_id = s.business_id
)
SELECT review_id, business_id, stars, label, label_count, text, length(text)::INTEGER AS text_length FROM j
""")
def labelled_reviews(spark, sf_dir):
    biz = single_target(_businesses(spark, sf_dir), TARGETS)
    rev = driver.reviews(spark, sf_dir)
    out = prepare_reviews(rev, biz, business_ids=biz, min_len=25)
    return out.select("review_id", "business_id", "stars", "label", "label_count", "text",
                      F.col("text_length").cast("int").alias("text_length"))


@register("joined_head_n", f"""
WITH {BIZ_CTE},
j AS (
  SELECT l.l_partkey AS business_id, l.l_orderkey, l.l_linenumber, l.l_shipdate, bc.name,
         bc.stars AS business_stars, bc.categories,
         row_number() OVER (PARTITION BY l.l_partkey ORDER BY l.l_shipdate, l.l_orderkey, l.l_linenumber) AS rn
  FROM lineitem l JOIN bc ON l.l_partkey = bc.business_id
)
SELECT business_id, l_orderkey, l_linenumber, name, business_stars, categories FROM j WHERE rn <= 3
""")
def joined_head_n(spark, sf_dir):
    li = driver.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("business_id"), "l_orderkey", "l_linenumber", "l_shipdate")
    out = join_reviews(li, _businesses(spark, sf_dir), 3, ["l_shipdate", "l_orderkey", "l_linenumber"])
    return out.select("business_id", "l_orderkey", "l_linenumber", "name", "business_stars", "categories")
