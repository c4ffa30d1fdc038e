"""Checks for sources, sinks and streaming ingestion over the driver tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.plans.registry import register
from kestrel.plans.rerank_plans import BASE, first_stage
from kestrel.session import cut_lineage, shared_dir
from kestrel.sources import driver
from kestrel.sources.io import read_json_table, search_results
from kestrel.streaming.ingest import ingest

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@register("stream_ingest_counts", """
SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang
""")
def stream_ingest_counts(spark, sf_dir):
    """Documents written as line-JSON files in the shared folder, ingested by a
    file-source stream one file per micro-batch, then counted from the Parquet sink."""
    src = shared_dir(spark, "json-src")
    driver.table(spark, sf_dir, "documents").repartition(4).write.mode("overwrite").json(src)
    sink, ckpt = shared_dir(spark, "ingest-sink"), shared_dir(spark, "ingest-ckpt")
    ingest(spark, src, DOC_SCHEMA, sink, ckpt, max_files_per_trigger=1)
    got = spark.read.parquet(sink)
    return got.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("bigint").alias("chars"))


@register("json_roundtrip_counts", """
SELECT source, count(*) AS n FROM documents GROUP BY source
""")
def json_roundtrip_counts(spark, sf_dir):
    """Line-JSON read back with an explicit schema (malformed lines dropped)."""
    src = shared_dir(spark, "json-docs")
    driver.table(spark, sf_dir, "documents").write.mode("overwrite").json(src)
    df = read_json_table(spark, src, DOC_SCHEMA)
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("search_result_counts", f"""{BASE},
ht AS (SELECT h.*, d.text FROM hits h JOIN documents d ON d.doc_id = h.doc_id)
SELECT category || '|' || beam_id::VARCHAR AS query, 0.1::DOUBLE AS similarity_threshold, count(*) AS total_retrieved,
       count_if(score >= 0.1) AS total_above_threshold
FROM ht GROUP BY category, beam_id
""")
def search_result_counts(spark, sf_dir):
    """K2: the nested search-result document per beam query (counts shown; reviews nested)."""
    _, hits = first_stage(spark, sf_dir)
    docs = driver.table(spark, sf_dir, "documents").select("doc_id", "text")
    h = (cut_lineage(hits).join(docs, "doc_id")  # few rows of known size: the corpus's texts are not moved
         .select(F.concat_ws("|", "category", F.col("beam_id").cast("string")).alias("query"),
                 F.col("doc_id").alias("review_id"), F.col("score").alias("cosine_similarity"), "text"))
    res = search_results(h, 0.1)
    return res.select("query", "similarity_threshold", "total_retrieved", "total_above_threshold")
