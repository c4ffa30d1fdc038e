"""F1-F16, F24, G1, A1, P4 on hand-made edge fixtures (FIXTURES E1, E2)."""

import re

from pyspark.sql import functions as F

from kestrel.functions.text import (
    clean_text, lemma_map, map_category_to_base, parse_categories, tokens,
)
from kestrel.operators.prepare import category_stats, prepare_reviews, single_target


def test_parse_categories_edges(spark):
    rows = [(1, None), (2, ""), (3, "A"), (4, " A , B "), (5, "A,,B"), (6, "A,A")]
    df = spark.createDataFrame(rows, "id int, categories string")
    got = {r.id: r.c for r in df.select("id", parse_categories("categories").alias("c")).collect()}
    assert got == {1: [], 2: [], 3: ["A"], 4: ["A", "B"], 5: ["A", "", "B"], 6: ["A", "A"]}


def test_single_target_counts_repeats_as_ambiguous(spark):
    rows = [("b1", "n", "c", "s", 4.0, 10, "A, X"), ("b2", "n", "c", "s", 3.0, 5, "A,A"),
            ("b3", "n", "c", "s", 2.0, 1, "X"), ("b4", "n", "c", "s", 1.0, 2, None),
            ("b5", "n", "c", "s", 5.0, 3, "B, A")]
    biz = spark.createDataFrame(rows, "business_id string, name string, city string, state string, "
                                      "stars double, review_count long, categories string")
    got = sorted(r.business_id for r in single_target(biz, ["A", "B"]).collect())
    assert got == ["b1"]  # b2 has A twice, b5 has A and B
    stats = {r.category: r for r in category_stats(biz).collect()}
    assert stats["A"].business_count == 4 and stats["X"].total_reviews == 11


def test_clean_text_unicode_whitespace(spark):
    rows = [(1, None), (2, "a\tb\n\nc"), (3, "  x  y  "), (4, "  ")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.c for r in df.select("id", clean_text("t").alias("c")).collect()}
    py = {1: "", 2: "a b c", 3: "x y", 4: ""}
    for k, v in [(2, "a\tb\n\nc"), (3, "  x  y  ")]:
        assert re.sub(r"\s+", " ", v).strip() == py[k]
    assert got == py


def test_length_filter_bounds(spark):
    t25 = "x" * 25
    rows = [("r1", "b", t25), ("r2", "b", "x" * 24), ("r3", "b", "  " + "y" * 500 + "  "), ("r4", "b", "z" * 501)]
    rev = spark.createDataFrame(rows, "review_id string, business_id string, text string")
    got = sorted(r.review_id for r in prepare_reviews(rev, min_len=25, max_len=500).collect())
    assert got == ["r1", "r3"]


def test_tokens_match_reference_rule(spark):
    text = ("Hello, world! It's well-known: (great) café... 42 x2 e-mail. Great beer,wings and fries...amazing! don't miss "
            "bar/pub (live)music, 3,4 o'clock, at 5:30,or gonna \"quote\" 'single' dogs' --dash--")
    got = spark.createDataFrame([(text,)], "t string").select(tokens("t").alias("k")).first().k
    assert got == ["hello", "world", "it", "great", "café", "great", "beer", "wings", "and", "fries", "amazing", "do", "miss",
                   "live", "music", "at", "or", "gon", "na", "quote", "single", "dogs", "dash"]


def test_lemma_needs_lexicon_and_prefers_shortest(spark):
    vocab = spark.createDataFrame([(w,) for w in ["boxes", "box", "boxe", "parties", "party", "was", "cats"]],
                                  "term string")
    got = {r.term: r.lemma for r in lemma_map(vocab).collect()}
    assert got["boxes"] == "box" and got["parties"] == "party"
    assert "was" not in got  # "wa" is not in the lexicon
    assert "cats" not in got  # "cat" is not in the lexicon


def test_map_category_to_base(spark):
    df = spark.createDataFrame([("Cocktail Bar  friendly",), ("plumber water",), ("Thai",)], "category string")
    got = [r.base_label for r in map_category_to_base(df, ["cocktail bar", "bar", "plumber"]).collect()]
    assert got == ["cocktail bar", "plumber", "thai"]
    got2 = [r.base_label for r in map_category_to_base(df, []).collect()]
    assert got2 == ["cocktail bar friendly", "plumber water", "thai"]
    assert df.select(F.lit(1)).count() == 3
