"""Sources and sinks.

Readers take explicit schemas (no inference on large inputs); writers keep
Parquet as the default table format and turn nested columns into JSON text
only for CSV.  File listing goes through the Hadoop FileSystem of the
session, so the same code works on local disk and on shared cluster storage.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The logical tables of the reference dataset, in matching order.
TABLE_ORDER = ["business", "review", "user", "tip", "checkin"]

BUSINESS_SCHEMA = T.StructType([
    T.StructField("business_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("categories", T.StringType()),
])

REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType(), False),
    T.StructField("business_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("useful", T.LongType()),
    T.StructField("funny", T.LongType()),
    T.StructField("cool", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("date", T.StringType()),
])

CORRUPT = "_corrupt_record"


# ---------------------------------------------------------------------------
# File system helpers
# ---------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on the session's file system."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """What tells one state of a file or folder from another: names, sizes and times of its files."""
    fs, p = _fs(spark, path)
    seen, files = fs.listFiles(p, True), []
    while seen.hasNext():
        st = seen.next()
        files.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:16]


def classify_files(spark: SparkSession, directory: str, order=TABLE_ORDER) -> dict[str, str]:
    """Map ``.json`` files of a directory to logical tables by case-insensitive
    substring of the file name; the first table name in ``order`` that matches wins."""
    fs, p = _fs(spark, directory)
    found: dict[str, str] = {}
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        low = name.lower()
        if not low.endswith(".json"):
            continue
        for t in order:
            if t in low:
                found.setdefault(t, st.getPath().toString())
                break
    return found


# ---------------------------------------------------------------------------
# Readers
# ---------------------------------------------------------------------------

def read_json_table(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None,
                    keep_rejects: bool = False) -> DataFrame:
    """Line-JSON with an explicit schema.

    Malformed lines are dropped (``keep_rejects=True`` keeps them with the raw
    text in ``_corrupt_record`` so they can be counted); blank lines are
    skipped by the reader.  ``limit`` counts parsed records only; None or 0
    means all.
    """
    if keep_rejects:
        full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
        df = (spark.read.schema(full).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    else:
        df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if limit:
        # the first records in file order, whichever task is done first
        where = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
        places = [f"_at{i}" for i in range(len(where))]
        df = df.select("*", *[c.alias(p) for c, p in zip(where, places)]).orderBy(*places).limit(limit).drop(*places)
    return df


def reject_count(df: DataFrame) -> DataFrame:
    """Rows the JSON reader could not parse (S2 message as a number).

    Spark refuses queries on raw JSON that reference only the corrupt-record
    column, so the whole (never null) row struct is referenced as well.
    """
    data_cols = [c for c in df.columns if c != CORRUPT]
    touch = F.hash(*data_cols) >= F.lit(-(2 ** 31))  # always true; keeps data columns referenced
    bad = F.col(CORRUPT).isNotNull() & touch
    return df.agg(F.count_if(bad).alias("rejected"), F.count_if(~bad).alias("parsed"))


def load_table(spark: SparkSession, files: dict[str, str], name: str, schema: T.StructType,
               limit: int | None = None) -> DataFrame:
    """Load a logical table; a missing table is an error."""
    if name not in files:
        raise ValueError(f"{name} file not found among {sorted(files)}")
    return read_json_table(spark, files[name], schema, limit)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header; quoted multi-line text; explicit schema preferred over inference."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def read_round_hits(spark: SparkSession, path: str) -> DataFrame:
    """Nested round document(s) -> one row per (category, review)."""
    doc = spark.read.option("multiLine", True).json(path)
    cats = doc.select(F.explode("categories").alias("c"))
    return cats.select(F.col("c.category").alias("category"), F.explode("c.reviews").alias("r")).select(
        "category", "r.*")


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """A search-result document (``{query, reviews: [...]}``) or JSONL of reviews.

    Returns flat review rows with ``query`` ('unknown' for JSONL) and
    ``total_above_threshold`` (row count for JSONL).
    """
    doc = spark.read.option("multiLine", True).json(path)
    if "reviews" in doc.columns:
        return doc.select("query", F.col("total_above_threshold").cast("bigint").alias("total_above_threshold"),
                          F.explode("reviews").alias("r")).select("query", "total_above_threshold", "r.*")
    rows = spark.read.json(path)
    if CORRUPT in rows.columns:
        rows = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    n = rows.agg(F.count(F.lit(1)).alias("total_above_threshold"))
    return rows.crossJoin(F.broadcast(n)).withColumn("query", F.lit("unknown"))  # one-row scalar


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A missing optional input gives an empty DataFrame with the schema, not a failure."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


# ---------------------------------------------------------------------------
# Writers
# ---------------------------------------------------------------------------

def _flatten_for_csv(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: CSV with header; nested columns as JSON text."""
    _flatten_for_csv(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """K5/K6/K8/K9: Parquet table, optionally partitioned (e.g. by round or cluster_id)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def search_results(hits: DataFrame, threshold: float, query_col: str = "query", score_col: str = "cosine_similarity",
                   id_col: str = "review_id", queries: DataFrame | None = None) -> DataFrame:
    """K2: per query: threshold, retrieved, above threshold, and the kept reviews (best score first, then
    id) with useful/funny/cool defaulting to 0.  One row per query, at most k reviews each; a query of
    ``queries`` without hits gets a row with totals 0."""
    cols = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") if c in hits.columns else F.lit(0).cast("bigint")
            for c in ("useful", "funny", "cool")}
    h = hits.withColumns(cols)
    keep = F.col(score_col) >= F.lit(threshold)
    review = F.struct((-F.col(score_col)).alias("_s"), F.col(id_col).alias("review_id"),
                      *[F.col(c) for c in ("business_id", "stars", "text") if c in hits.columns],
                      F.col(score_col).alias("cosine_similarity"), "useful", "funny", "cool")
    agg = h.groupBy(query_col).agg(
        F.count(F.lit(1)).alias("total_retrieved"),
        F.count_if(keep).alias("total_above_threshold"),
        F.sort_array(F.collect_list(F.when(keep, review))).alias("_r"))
    if queries is not None:
        agg = (queries.select(query_col).distinct().join(agg, query_col, "left")
               .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("total_retrieved", "total_above_threshold")})
               .withColumn("_r", F.coalesce("_r", F.array().cast(agg.schema["_r"].dataType))))
    return agg.select(F.col(query_col).alias("query"), F.lit(threshold).alias("similarity_threshold"),
                      "total_retrieved", "total_above_threshold",
                      F.transform("_r", lambda r: r.dropFields("_s")).alias("reviews"))


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """K2/K3/K7: JSON lines (non-ASCII kept as is)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def add_tfidf(results: DataFrame, top_words: DataFrame, summary: DataFrame, query_col: str = "query") -> DataFrame:
    """K4: attach ``tfidf_analysis {top_words[{word, tfidf_score}], total_unique_terms, total_documents}``
    per query.  ``top_words`` is (query, term, score, rank); ``summary`` is (query, totals)."""
    tw = top_words.groupBy(query_col).agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("term").alias("word"), F.col("score").alias("tfidf_score")))).alias("_tw"))
    a = tw.join(summary, query_col, "full").select(query_col, F.struct(
        F.transform(F.coalesce("_tw", F.array()), lambda s: s.dropFields("rank")).alias("top_words"),
        F.coalesce("total_unique_terms", F.lit(0)).alias("total_unique_terms"),
        F.coalesce("total_documents", F.lit(0)).alias("total_documents")).alias("tfidf_analysis"))
    return results.join(a, query_col, "left")


def label_map(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Alphabetical label -> id dimension table."""
    d = labels.select(label_col).distinct()  # K distinct labels: one small window
    return d.withColumn("label_id", (F.dense_rank().over(Window.orderBy(label_col)) - 1).cast("int"))
