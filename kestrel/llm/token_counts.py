"""Token counts: how many tokens each document has, without making the tokens.

A byte-level BPE vocabulary file cuts a text into pre-tokens first and never joins across them, so a text's
token count is the sum over its pre-tokens.

1. Every task counts the pre-tokens of its texts; the counts are summed into the corpus vocabulary, a table.
2. The tokenizer counts the pieces of each distinct pre-token once.
3. Each document's pre-token frequencies meet these numbers in a join, and their products are summed.

Pre-tokens with a share of ``HEAD_SHARE`` or more of the corpus and at most ``HEAD_BYTES`` bytes, of which there
are at most 1 / HEAD_SHARE, are also broadcast and summed where the text is read.  That changes no count; it keeps
hot keys out of the join.  All others travel as (row, pre-token, times).  A document's own row travels in the same
join under a key that is no pre-token.

Special tokens of the file that stand in a text count one each, as the library does by default; none are added.
A null or empty text has no bytes and no tokens.  Rows are counted as often as they are listed, a null id stays
null, columns besides the id and the text are left out, so no name can clash.  Texts are read whole, however long.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrel.session import cut_lineage, spread

LIMIT = 1024
HEAD_SHARE = 1e-6
HEAD_BYTES = 48
#: Different pre-tokens that a counting task holds before it hands them on.
HELD = 200_000
#: Pre-tokens given to the tokenizer at a time.
ENCODED = 8192
#: The split pattern of such a vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these code points Unicode versions may class a character differently, so the library itself splits the text.
SETTLED = re.compile("[^\x00-ɏͰ-ϿЀ-џ‐-‧‰-⁞€]")


class Splitter:
    """Pre-tokens of a text, and the number of special tokens in it."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = file.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space") or file.get("normalizer"):
            raise ValueError("not a byte-level vocabulary file without normalisation")
        added = file.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special tokens that take in their surroundings are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.cut = regex.compile(PATTERN).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer

    def _words(self, text: str) -> list[str]:
        if SETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.cut(text)

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self.special is None or self.special.search(text) is None:
            return self._words(text), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self._words(p)], len(parts) - 1


def vocabulary(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(pretoken, times): every pre-token of the corpus with its occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = Splitter(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text)[0])
                if len(seen) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "times"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "times"])

    found = spread(docs.select(text_col)).mapInArrow(run, "pretoken string, times long")
    return found.groupBy("pretoken").agg(F.sum("times").alias("times"))


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """(pretoken, times, pieces): the pieces of each distinct pre-token, counted once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        bpe = Tokenizer.from_file(path)
        bpe.no_truncation()
        bpe.no_padding()
        for batch in batches:
            names = batch.column(0).to_pylist()
            pieces = []
            for lo in range(0, len(names), ENCODED):
                pieces += [len(e) for e in bpe.encode_batch_fast(names[lo:lo + ENCODED], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int32())], ["pretoken", "times", "pieces"])

    return words.select("pretoken", "times").mapInArrow(run, "pretoken string, times long, pieces int")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    spark = docs.sparkSession
    pieces = cut_lineage(piece_counts(vocabulary(docs, path, text_col), path))
    total = pieces.agg(F.sum("times")).first()[0] or 0
    hot = pieces.where((F.col("times") >= HEAD_SHARE * total) & (F.octet_length("pretoken") <= HEAD_BYTES))
    head = spark.sparkContext.broadcast({r[0]: r[1] for r in hot.select("pretoken", "pieces").toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = Splitter(path), head.value
        names = ["row", "doc_id", "n_bytes", "pretoken", "times"]
        for batch in batches:
            rows, words, times = [], [], []
            own, sizes, sums = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                found, count = split(text) if text else ([], 0)
                for word, n in Counter(found).items():
                    k = known.get(word)
                    if k is None:
                        rows.append(row)
                        words.append(word)
                        times.append(n)
                    else:
                        count += k * n
                own.append(f"\x00{row}")
                sizes.append(len(text.encode()) if text else 0)
                sums.append(count)
            n = len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(own, pa.string()), pa.array(sums, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(words, pa.string()), pa.array(times, pa.int64())], names)

    numbered = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = numbered.mapInArrow(run, "row long, doc_id long, n_bytes long, pretoken string, times long")
    met = parts.join(pieces.select("pretoken", "pieces"), "pretoken", "left")
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                  F.sum(F.col("times") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
    return sums.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
