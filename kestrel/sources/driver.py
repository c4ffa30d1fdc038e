"""Views of the driver's parquet tables in the shapes the operators expect.

The driver ships TPC-H-like tables plus text tables.  The reference works on
businesses, reviews and embedding vectors; these functions derive those shapes
from the given tables with plain projections and joins, so every query's work
grows with the data:

* reviews     <- ``documents`` (+ ``labels`` for stars/useful)
* businesses  <- ``part`` (categories = type and the two words of the name)
* vectors     <- ``embeddings`` (unit-normalised here)
* category queries <- per-label mean vectors of ``embeddings``

``vec_id``/``doc_id`` and ``doc_id``/``p_partkey`` are unrelated in the data;
where two of them meet it is by equal id, a synthetic pairing only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.functions.vectors import l2_normalize, mean_vectors

# Fixed test configuration: the target categories mix part types and name words,
# so businesses carry 0, 1 or 2 targets.
TARGET_CATEGORIES = ["PROMO", "SMALL", "widget", "bolt", "gear"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("review_id"),
                    F.col("doc_id").alias("business_id"),
                    F.col("source").alias("user_id"),
                    F.col("quality").cast("double").alias("stars"),
                    F.coalesce(F.col("toxic"), F.lit(0)).cast("bigint").alias("useful"),
                    F.lit(0).cast("bigint").alias("funny"),
                    F.lit(0).cast("bigint").alias("cool"),
                    "text", "lang"))


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return part.select(
        F.col("p_partkey").alias("business_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("city"),
        F.col("p_type").alias("state"),
        (F.col("p_size") / F.lit(10.0)).alias("stars"),
        F.col("p_size").cast("bigint").alias("review_count"),
        F.concat_ws(", ", "p_type", F.get(words, 0), F.get(words, 1)).alias("categories"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("id"), l2_normalize("embedding").alias("embedding"),
                      F.col("label").cast("int").alias("label"))


def category_name(label_col) -> F.Column:
    return F.concat(F.lit("label_"), F.col(label_col).cast("string"))


def centroid_queries(vecs: DataFrame) -> DataFrame:
    """One query per label: its normalised mean vector (category, qvec)."""
    m = mean_vectors(vecs, "label", "embedding", "qvec")
    return m.select(category_name("label").alias("category"), l2_normalize("qvec").alias("qvec"))


def beam_queries(vecs: DataFrame, num_beams: int = 3) -> DataFrame:
    """Beams per label: the vectors of its ``num_beams`` lowest ids (category, beam_id, qvec)."""
    w = Window.partitionBy("label").orderBy("id")
    return (vecs.withColumn("beam_id", F.row_number().over(w))
            .where(F.col("beam_id") <= num_beams)
            .select(category_name("label").alias("category"), "beam_id",
                    F.col("embedding").alias("qvec")))
