import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm import queries, token_counts as TC

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(PATH)
ODD = ["", None, "one", "it's we'll  two\n\n three   ", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext|",
       "Ünïcödé ñandú — “quoted”…", "привет мир", "漢字かな交じり文", "a b c\x1cd\x85e", "🙂🙂 x", "\x00123 \x00", "1234567 ½ ²", "x" * 5000,
       " " * 3000, "'sunday 'll'll", "՘₏֋ a", "tab\tnew\r\nline", "ok " * 20000]


def plain(text):
    return len(OWN.encode(text or "", add_special_tokens=False).ids)


def rows_of(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


def expected(pairs):
    out = []
    for i, t in pairs:
        n = plain(t)
        out.append((i is not None, i or 0, len((t or "").encode()), n, n > 1024))
    return sorted(out)


@pytest.mark.parametrize("share", [TC.HEAD_SHARE, 2.0, 1e-3])
def test_odd_texts_with_and_without_a_broadcast_head(spark, monkeypatch, share):
    monkeypatch.setattr(TC, "HEAD_SHARE", share)
    pairs = list(enumerate(ODD)) + [(None, "no id"), (None, None), (3, ODD[3]), (3, "another text of the id")]
    df = spark.createDataFrame(pairs, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("pretoken", F.lit(1)).withColumn("n_tokens", F.lit(9))
    assert rows_of(TC.token_counts(df, PATH)) == expected(pairs)


def test_empty_table(spark):
    out = TC.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


def test_each_pretoken_is_encoded_once(spark):
    df = spark.createDataFrame([(i, "same words here, same words there") for i in range(50)], "doc_id long, text string")
    words = TC.vocabulary(df.repartition(7), PATH).collect()
    assert len({w.pretoken for w in words}) == len(words) and sum(w.times for w in words if w.pretoken == " words") == 100


def test_query_equals_the_library_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.queries()["op11_token_counts"](spark, sf)) == expected(docs)


def test_unlike_vocabulary_is_refused(spark):
    with pytest.raises(ValueError):
        TC.Splitter(public_tokenizers.path("word_bpe_49k.json"))
