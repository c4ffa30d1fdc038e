"""S1, S2, S3, S10, S11, K1, K2 and the streaming ingest."""

import json
import os

from pyspark.sql import types as T

from kestrel.sources.io import (
    BUSINESS_SCHEMA, classify_files, path_exists, read_json_table, read_optional, read_search_results,
    reject_count, search_results, write_csv,
)
from kestrel.streaming.ingest import ingest


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_json_lines_broken_blank_extra_missing(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "biz.json")
    _write(p, ['{"business_id": "b1", "name": "A", "stars": 4.5}', "{broken", "",
               '{"business_id": "b2", "extra": 1}', '{"business_id": "b3", "categories": "X, Y"}'])
    df = read_json_table(spark, p, BUSINESS_SCHEMA)
    assert sorted(r.business_id for r in df.collect()) == ["b1", "b2", "b3"]
    rc = reject_count(read_json_table(spark, p, BUSINESS_SCHEMA, keep_rejects=True)).first()
    assert rc.rejected == 1 and rc.parsed == 3
    assert read_json_table(spark, p, BUSINESS_SCHEMA, limit=2).count() == 2
    assert read_json_table(spark, p, BUSINESS_SCHEMA, limit=0).count() == 3


def test_classify_files_first_match(spark, tmpdir_path):
    for name in ["yelp_business.json", "Review_2024.JSON", "user_reviews.json", "tip.txt", "checkin.json"]:
        _write(os.path.join(tmpdir_path, name), ["{}"])
    found = classify_files(spark, tmpdir_path)
    assert found["business"].endswith("yelp_business.json")
    # "user_reviews.json" contains "review" first in table order, so review wins over user
    assert set(found) == {"business", "review", "checkin"}
    assert path_exists(spark, tmpdir_path) and not path_exists(spark, tmpdir_path + "/nope")
    empty = read_optional(spark, tmpdir_path + "/nope", T.StructType([T.StructField("a", T.IntegerType())]))
    assert empty.count() == 0


def test_search_results_document_and_jsonl(spark, tmpdir_path):
    doc = os.path.join(tmpdir_path, "res.json")
    with open(doc, "w") as f:
        json.dump({"query": "pub", "total_above_threshold": 2,
                   "reviews": [{"review_id": "r1", "text": "a"}, {"review_id": "r2", "text": "b"}]}, f)
    d = read_search_results(spark, doc)
    assert d.count() == 2 and d.first().query == "pub"
    jl = os.path.join(tmpdir_path, "res.jsonl")
    _write(jl, ['{"review_id": "r1", "text": "a"}', '{"review_id": "r2", "text": "b"}', ""])
    j = read_search_results(spark, jl)
    assert j.count() == 2 and {r.query for r in j.collect()} == {"unknown"}
    assert {r.total_above_threshold for r in j.collect()} == {2}


def test_search_results_sink_defaults(spark, tmpdir_path):
    hits = spark.createDataFrame([("pub", "r1", 0.9, "t1"), ("pub", "r2", 0.4, "t2"), ("pub", "r3", 0.7, "t3")],
                                 "query string, review_id string, cosine_similarity double, text string")
    out = search_results(hits, 0.7).first()
    assert out.total_retrieved == 3 and out.total_above_threshold == 2
    assert [r.review_id for r in out.reviews] == ["r1", "r3"] and out.reviews[0].useful == 0
    write_csv(search_results(hits, 0.7), os.path.join(tmpdir_path, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv"))
    assert back.count() == 1


def test_streaming_ingest_counts_all(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    os.makedirs(src)
    for i in range(3):
        _write(os.path.join(src, f"part{i}.json"),
               [json.dumps({"business_id": f"b{i}-{j}"}) for j in range(4)] + ["{bad"])
    n = ingest(spark, src, BUSINESS_SCHEMA, os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck"))
    assert n == 12
    assert spark.read.parquet(os.path.join(tmpdir_path, "sink")).where("business_id IS NOT NULL").count() == 12
    # the same batches once more, as after a crash before the commit: each replaces itself
    again = ingest(spark, src, BUSINESS_SCHEMA, os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck2"))
    assert again == 12 and spark.read.parquet(os.path.join(tmpdir_path, "sink")).count() == 12


def test_streaming_ingest_stops_early_and_resumes(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    os.makedirs(src)
    for i in range(5):
        _write(os.path.join(src, f"part{i}.json"), [json.dumps({"business_id": f"b{i}-{j}"}) for j in range(4)])
    sink, ck = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck")
    assert ingest(spark, src, BUSINESS_SCHEMA, sink, ck, max_rows=6) == 8
    assert ingest(spark, src, BUSINESS_SCHEMA, sink, ck) == 12
    assert spark.read.parquet(sink).select("business_id").distinct().count() == 20


def test_search_results_ties_and_queries_without_hits(spark):
    hits = spark.createDataFrame([("pub", "b", 0.9), ("pub", "a", 0.9), ("pub", "c", 0.95)],
                                 "query string, review_id string, cosine_similarity double")
    queries = spark.createDataFrame([("pub",), ("bar",)], "query string")
    out = {r["query"]: r for r in search_results(hits, 0.5, queries=queries).collect()}
    assert [r.review_id for r in out["pub"].reviews] == ["c", "a", "b"]
    assert out["bar"].total_retrieved == out["bar"].total_above_threshold == 0 and out["bar"].reviews == []


def test_round_document_reader(spark, tmpdir_path):
    from kestrel.sources.io import read_round_hits
    doc = {"round": "r0", "categories": [
        {"category": "pub", "reviews": [{"review_id": "r1", "ce_score": 1.0, "text": "a"},
                                        {"review_id": "r2", "ce_score": 0.5, "text": "b"}]},
        {"category": "bar", "reviews": [{"review_id": "r1", "ce_score": 0.7, "text": "a"}]}]}
    p = os.path.join(tmpdir_path, "round.json")
    with open(p, "w") as f:
        json.dump(doc, f, indent=2)
    rows = sorted((r.category, r.review_id) for r in read_round_hits(spark, p).collect())
    assert rows == [("bar", "r1"), ("pub", "r1"), ("pub", "r2")]


def test_add_tfidf_analysis(spark):
    from kestrel.sources.io import add_tfidf
    results = spark.createDataFrame([("q1", 3), ("q2", 0)], "query string, total_retrieved long")
    top = spark.createDataFrame([("q1", "wine", 0.4, 2), ("q1", "beer", 0.5, 1)],
                                "query string, term string, score double, rank int")
    summ = spark.createDataFrame([("q1", 10, 3)], "query string, total_unique_terms long, total_documents long")
    out = {r.query: r.tfidf_analysis for r in add_tfidf(results, top, summ).collect()}
    assert [w.word for w in out["q1"].top_words] == ["beer", "wine"]
    assert out["q1"].total_unique_terms == 10 and out["q2"] is None
