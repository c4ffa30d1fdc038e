import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kestrel.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rnd = random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "\r\n", "\xa0", " ", "\x1c", "\x85", "a", "Word", "it's", "l'été", "你好", "🙂", "123", "#$%", "<|endoftext|>", "'ll", "　"]
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(400)] + ["", " ", "\n\n x", "x  ", "<|endoftext|>"]


def test_ids_are_those_of_the_vocabularys_tokenizer(spark):
    texts = odd_texts() + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, at = P.Encoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    own = Tokenizer.from_file(PATH)
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == own.encode(t, add_special_tokens=False).ids + [1], repr(t)


@pytest.mark.parametrize("length,windows,slack", [(64, 4, 8), (2048, 64, 32)])
def test_every_id_is_in_one_piece_with_nulls_ties_and_repeated_rows(spark, length, windows, slack):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["the", "and", "xyzzy", "É"]) for _ in range(rnd.randint(0, 120)))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "no id"), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, length int").repartition(3)
    out = P.pack(df, PATH, length, windows, slack, with_ids=True).collect()
    own = Tokenizer.from_file(PATH)
    want = sorted((str(i), own.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    by_doc = {}
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(str(r.doc_id), []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.doc_tokens))
    got = []
    for doc, parts in by_doc.items():
        listed = 2 if doc == "3" else 1
        assert sum(len(p[1]) for p in parts) == listed * parts[0][2]
        if listed == 1:
            got.append((doc, sum((p[1] for p in sorted(parts)), [])))
    assert sorted(got) == [w for w in want if w[0] != "3"]
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fill = []
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0] + [p[1] for p in parts[:-1]]).tolist()
        fill.append(sum(p[1] for p in parts))
    assert max(fill) <= length
    assert sorted(fill)[1:] == [] or sorted(fill)[1] >= length - slack


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
