"""LM scoring: a word n-gram model as a weighted backoff automaton, built per shard of documents from whole-corpus counts.

Training counts every word of the training documents; a word's probability is additive (``ALPHA``), with one
share for all unknown words.  Every n-gram of two or more occurrences is an arc, smoothed by absolute
discounting: log10 of (n - ``DISCOUNT``) / count of its context.  A context is a state; its failure arc leads to the
context without its first word and weighs what makes the state's probabilities sum to one.  A text is
read once from left to right: the state is carried from word to word, failure arcs are followed until an arc for the
word is found, weights are added up, and the arc's end is the next state.

The model grows with the corpus, and no task ever holds it.  Texts are tokenised once into shards of about
``SHARD`` bytes, written as a table bucketed by shard.  A shard needs only the states and arcs of n-grams that occur in it,
and asks for them: it sends its distinct n-grams as sorted 64-bit hashes with its own counts, dealt by their first
bits, and each bucket adds up the counts of all shards and answers every shard in the order asked, so that no hash travels back.
An n-gram of three or more words is asked for only if both n-grams in it were kept.  Each kept n-gram has one owner
among the shards that hold it.  Owners add up, by context, the mass of the arcs and the probability that the
shorter context gives to the same words; a second exchange of the same form sums these over the corpus, which gives the failure weights.

Hot words and n-grams are one entry per shard, whatever their frequency; buckets are hash ranges, sized by the
number of tokens (``ASKED`` each).  For reading, texts are cut into lanes of ``LANE`` tokens that advance together; a lane
inside a text first reads the ``order - 1`` words before it without counting them, which sets the state exactly.

``head_share`` and ``arc_share`` of ``score`` prune the model for those who want a small one: n-grams of
words below the first, or themselves below the second, get no arc.  Both are 0 by default.

A null or empty text has the end token only.  A null id counts as the id '' (held out).  Repeated
rows are trained on and scored as often as they are listed.  Very long texts are a shard of their own.  Columns other than id
and text are left out, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from kestrel.llm import hashing as H, texts as T
from kestrel.session import cut_lineage, shared_dir

ALPHA = 0.1
ORDER = 3
DISCOUNT = 0.75
LEAST = 2
#: The end token and the start of a text; no word has these hashes but by chance of 2**-63.
END, START = 0, 1
#: Bytes of text in a shard, shards in a bucket of the shard table, n-grams asked of one bucket, tokens of a lane.
SHARD, TOGETHER, ASKED, LANE = 8 << 20, 4, 1 << 20, 256
HELD_SHARES = 10
#: ``kind`` of a request: the n-gram's words for counts; this more for what failure weights need.
FAIL = 1000


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of concatenated texts, an end after each, and the token offset of each text."""
    data = H.LOWER[data]
    starts, stops, at = H.words(data, off)
    n = len(at) - 1
    out = np.full(len(starts) + n, END, dtype=np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(at))] = H.word_hashes(data, starts, stops)
    return out, at + np.arange(n + 1)


def training(docs: DataFrame) -> DataFrame:
    """Whether a document is held out: crc32 of its id as text, modulo ten, is 0."""
    public = F.coalesce(T.public_id().cast("string"), F.lit(""))
    return docs.withColumn("held_out", F.crc32(public) % HELD_SHARES == 0)


def _streams(tok: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Texts with their start: tokens, text of each, token's place in its text (start 0), hashes of the n-grams that end there.

    The hash of an n-gram that would reach before the start is of no use.
    """
    n = np.diff(off) + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    stream = np.full(begin[-1], START, np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(stream)) - begin[owner]
    stream[place > 0] = tok
    p, at = H.prefix(stream), np.arange(len(stream))
    return stream, owner, place, [H.ranges(p, np.maximum(at - m + 1, 0), at + 1) for m in range(1, order + 1)]


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpack(data: bytes, dtype=np.uint64) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, len(raw) // dtype.itemsize).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    cols = zip(*rows) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), kinds[t]) for c, t in zip(cols, types)], names=list(names))


SHARDS = "shard long, docs binary, held binary, size binary, words binary, seq binary, tokens long"


def shards(keyed: DataFrame) -> DataFrame:
    """Tokenised texts, a row per shard: ids, held-out flags and token counts of its texts, its distinct words, and the word of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            ids, held = batch.column("doc_id").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False)
            copy, listing = batch.column("copy").to_numpy(), batch.column("listing").to_numpy()
            for lo, hi in T.pieces(off, SHARD):
                tok, at = tokens(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                words, seq = np.unique(tok, return_inverse=True)
                key = H.mix(H.mix(H.mix(ids[lo:lo + 1].view(np.uint64)) + copy[lo:lo + 1].astype(np.uint64)) + listing[lo:lo + 1].astype(np.uint64))
                row = (int(key.view(np.int64)[0]), pack(ids[lo:hi]), pack(held[lo:hi]), pack(np.diff(at)), pack_sorted(words), pack(seq.astype(np.uint32)), len(tok))
                yield from _rows([row], SHARDS).to_batches()

    return keyed.select("doc_id", "copy", "listing", "held_out", "text").mapInArrow(run, SHARDS)


def _bucketed(table: DataFrame, buckets: int) -> DataFrame:
    """``table`` stored by shard, so that joins by shard move only the other side."""
    spark, name = table.sparkSession, f"kestrel_shards_{uuid.uuid4().hex[:12]}"
    table.write.bucketBy(buckets, "shard").option("path", shared_dir(spark, "shards")).saveAsTable(name)
    return spark.table(name)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the rank of every key.  (``np.unique`` sorts stably, which takes several times as long.)"""
    by = np.argsort(keys)
    ordered = keys[by]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[by] = np.cumsum(new) - 1
    return ordered[new], by[new], rank


class Answers:
    """What the buckets answered to one shard, in the order in which it asked."""

    def __init__(self, table: pa.Table):
        self.rows = sorted(table.select(["kind", "bucket", "x", "y", "z"]).to_pylist(), key=lambda r: r["bucket"])

    def __call__(self, kind: int, field: str, dtype=np.uint64) -> np.ndarray:
        found = [unpack(r[field], dtype) for r in self.rows if r["kind"] == kind]
        return np.concatenate(found) if found else np.zeros(0, dtype)


class Shard:
    """A shard's texts as one stream, and the n-grams of it that the model holds, as far as answers have come."""

    def __init__(self, row: dict, order: int):
        self.docs, self.held, self.size = unpack(row["docs"], np.int64), unpack(row["held"], bool), unpack(row["size"], np.int64)
        seq, words = unpack(row["seq"], np.uint32).astype(np.int64), unpack_sorted(row["words"])
        self.width = len(words)
        off = np.concatenate([[0], np.cumsum(self.size)])
        stream, self.owner, self.place, self.grams = _streams(words[seq], off, order)
        self.word = np.zeros(len(stream), np.int64)
        self.word[self.place > 0] = seq
        self.train = ~self.held[self.owner]
        self.order = order
        self.count: dict[int, np.ndarray] = {}  # by words of the n-gram: occurrences in the corpus, by position of its last word
        self.node: dict[int, np.ndarray] = {}   # and its state, 0 where it is not kept
        self.first: dict[int, np.ndarray] = {}  # and, by n-gram, a position where it ends
        self.nodes = 2  # the empty context and the start of a text

    def asked(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions, n-gram of each, distinct n-grams in order of hash, a position of each."""
        at = self.place >= max(1, m - 1)
        if m > 2:
            at &= self.node[m - 1] > 0
            at[1:] &= self.node[m - 1][:-1] > 0
        at = np.flatnonzero(at)
        if m == 1:  # by distinct words
            word = self.word[at]
            place = np.zeros(self.width, np.int64)
            place[word] = at
            keys, first, slot = distinct(self.grams[0][place])
            return at, slot[word], keys, place[first]
        keys, first, slot = distinct(self.grams[m - 1][at])
        return at, slot, keys, at[first]

    def request(self, m: int, row: dict, bits: int) -> list[tuple]:
        at, slot, keys, _ = self.asked(m)
        n = np.bincount(slot, weights=self.train[at], minlength=len(keys)).astype(np.uint64)
        return _dealt(m, row["shard"], bits, keys, n)

    def learn(self, m: int, answers: Answers, least: float, head: float) -> None:
        at, slot, keys, first = self.asked(m)
        n = answers(m, "x").astype(np.int64)
        self.first[m], self.count[m] = first, np.zeros(len(self.place), np.int64)
        self.count[m][at] = n[slot]
        kept = np.zeros(len(self.place), bool)
        if m == 1:
            self.count[1][self.place == 0] = n[keys == _gram(END)].sum()  # a text has one start and one end
            kept[at] = (n[slot] >= LEAST) & (n[slot] >= head)
        else:
            kept[at] = n[slot] >= least
            if m == 2:
                kept[at] &= (self.node[1][at] > 0) & (self.node[1][at - 1] > 0)
        self.node[m] = np.zeros(len(self.place), np.int64)
        self.node[m][at] = np.where(kept[at], self.nodes + slot, 0)
        if m == 1:
            self.node[1][self.place == 0] = 1
        self.nodes += len(keys)

    def arcs(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the distinct n-grams are kept, and a position of each that is."""
        kept = self.node[m][self.first[m]] > 0
        return kept, self.first[m][kept]

    def own(self, m: int, answers: Answers) -> np.ndarray:
        """A position of each kept n-gram that this shard owns."""
        kept, at = self.arcs(m)
        return at[answers(m, "y", bool)[kept]]

    def contexts(self, c: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States of ``c`` words whose failure arc is followed here, or that have an arc of ``own``: hash and a position of each, in order of hash."""
        state = self.node[c]
        used = np.zeros(self.nodes, bool)
        used[state[:-1][(self.place[1:] > 0) & (self.node[c + 1][1:] == 0)]] = True
        used[state[own - 1]] = True
        _, at = self.arcs(c)
        if c == 1:
            at = np.concatenate([np.flatnonzero(self.place == 0)[:1], at])
            at = at[np.argsort(self.grams[0][at])]
        at = at[used[state[at]]]
        return self.grams[c - 1][at], at

    def lower(self, c: int, at: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
        """Probability of the word at ``at`` after the ``c - 1`` words before it, where that n-gram is kept."""
        if c == 1:
            return (self.count[1][at] + ALPHA) / (total + ALPHA * (vocabulary + 1))
        return (self.count[c][at] - DISCOUNT) / self.count[c - 1][at - 1]

    def owed(self, c: int, row: dict, bits: int, answers: Answers, total: int, vocabulary: int) -> list[tuple]:
        """Request of the failure weights after ``c`` words, with what this shard's own arcs add to them."""
        arc = self.own(c + 1, answers)
        keys, at = self.contexts(c, arc)
        state = self.node[c][arc - 1]
        sums = [np.bincount(state, weights=w, minlength=self.nodes)[self.node[c][at]]
                for w in (np.ones(len(arc)), self.count[c + 1][arc], self.lower(c, arc, total, vocabulary))]
        return _dealt(FAIL + c, row["shard"], bits, keys, sums[0].astype(np.uint64), sums[1].astype(np.uint64), sums[2])

    def automaton(self, answers: Answers, total: int, vocabulary: int):
        """Arcs (sorted keys, weight, end), and the failure arc of every state (weight, end)."""
        fail, back = np.zeros(self.nodes), np.zeros(self.nodes, np.int64)
        keys, weight, end = [], [], []
        known = self.first[1][self.count[1][self.first[1]] > 0]
        top = max(1, self.order - 1)
        for m in range(1, self.order + 1):
            at = known if m == 1 else self.arcs(m)[1]
            source = self.node[m - 1][at - 1] if m > 1 else np.zeros(len(at), np.int64)
            keys.append(source * self.width + self.word[at])
            weight.append(np.log10(self.lower(m, at, total, vocabulary)))
            end.append(self.node[min(m, top)][at] if self.order > 1 else np.zeros(len(at), np.int64))
        for c in range(1, self.order):
            if c > 1:
                _, at = self.arcs(c)
                back[self.node[c][at]] = self.node[c - 1][at]
            _, at = self.contexts(c, self.own(c + 1, answers))
            state = self.node[c][at]
            arcs, n, under = answers(FAIL + c, "x"), answers(FAIL + c, "y"), answers(FAIL + c, "z", np.float64)
            left = np.maximum(1 - (n - DISCOUNT * arcs) / np.maximum(self.count[c][at], 1), 1e-9)
            fail[state] = np.where(arcs > 0, np.log10(left / np.maximum(1 - under, 1e-9)), 0.0)
        keys, weight, end = (np.concatenate(x) for x in (keys, weight, end))
        by = np.argsort(keys)
        return keys[by], weight[by], end[by], fail, back

    def read(self, automaton, unknown: float) -> np.ndarray:
        """The score of every text: all lanes advance by one word a step and carry their states."""
        keys, weight, end, fail, back = automaton
        begin = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1] + 1  # position of each text's first word
        lanes = -(-self.size // LANE)
        text = np.repeat(np.arange(len(lanes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        warm = np.where(nth > 0, self.order - 1, 0)
        at = begin[text] + nth * LANE - warm
        length = np.minimum(LANE, self.size[text] - nth * LANE) + warm
        by = np.argsort(-length, kind="stable")
        text, warm, at, length = text[by], warm[by], at[by], length[by]
        state = np.where(warm > 0, 0, 1 if self.order > 1 else 0)
        if self.order > 1:
            state[nth[by] > 0] = 0
        score, live = np.zeros(len(text)), len(text)
        for t in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length[:live], -t, side="left"))
            word, now, here = self.word[at[:live] + t], state[:live].copy(), np.arange(live)
            gain, after = np.zeros(live), np.zeros(live, np.int64)
            while len(here):
                key = now * self.width + word
                j = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                hit = keys[j] == key if len(keys) else np.zeros(len(here), bool)
                gain[here[hit]] += weight[j[hit]]
                after[here[hit]] = end[j[hit]]
                gain[here[~hit & (now == 0)]] += unknown
                on = ~hit & (now > 0)
                here, word, now = here[on], word[on], now[on]
                gain[here] += fail[now]
                now = back[now]
            score[:live] += np.where(t >= warm[:live], gain, 0.0)
            state[:live] = after
        return np.bincount(text, weights=score, minlength=len(self.size))


def _gram(token: int) -> np.uint64:
    """The hash of one token as it appears among n-grams."""
    return H.ranges(H.prefix(np.array([token], np.uint64)), np.array([0]), np.array([1]))[0]


REQUEST = "kind int, bucket int, shard long, keys binary, x binary, y binary, z binary"
ANSWER = "shard long, kind int, bucket int, x binary, y binary, z binary, tokens long, distinct long"


def _dealt(kind: int, shard: int, bits: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Requests of one shard, cut by the first bits of the sorted keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
    out = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        packed = [pack(v[lo:hi]) for v in values] + [b""] * (3 - len(values))
        out.append((kind, int(bucket[lo]), shard, pack_sorted(keys[lo:hi]), *packed))
    return out


def _answered(requests: DataFrame) -> DataFrame:
    """Sums over all shards by key, given back to every shard that asked."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kind, bucket = rows[0]["kind"], rows[0]["bucket"]
        keys = [unpack_sorted(r["keys"]) for r in rows]
        cut = np.cumsum([0] + [len(k) for k in keys])
        found, first, at = distinct(np.concatenate(keys))

        def total(field, dtype=np.uint64):
            return np.bincount(at, weights=np.concatenate([unpack(r[field], dtype) for r in rows]), minlength=len(found))

        n = total("x")
        tokens = words = 0
        if kind < FAIL:
            if kind == 1:
                tokens, words = int(n.sum()), int((n > 0).sum())
            owner = np.zeros(len(at), bool)
            owner[first] = True
            columns = [np.where(n >= min(kind, LEAST), n, 0).astype(np.uint64)[at], owner]
        else:
            columns = [n.astype(np.uint64)[at], total("y").astype(np.uint64)[at], total("z", np.float64)[at]]
        out = []
        for i, r in enumerate(rows):
            packed = [pack(c[cut[i]:cut[i + 1]]) for c in columns] + [b""] * (3 - len(columns))
            out.append((r["shard"], kind, bucket, *packed, tokens if i == 0 else 0, words if i == 0 else 0))
        return _rows(out, ANSWER)

    return cut_lineage(requests.groupBy("kind", "bucket").applyInArrow(run, ANSWER))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER, head_share: float = 0.0, arc_share: float = 0.0,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (log10)."""
    keyed = training(T.keyed(docs, id_col, text_col))
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    table = _bucketed(shards(keyed), max(16, size // (SHARD * TOGETHER)))
    tokens_all = table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bits = max(4, int(tokens_all // ASKED).bit_length())
    start = min(order, 2)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row, start)
                yield from _rows([r for m in range(1, start + 1) for r in shard.request(m, row, bits)], REQUEST).to_batches()

    answers = _answered(table.mapInArrow(first, REQUEST))
    total, vocabulary = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    least, head = max(LEAST, arc_share * total), head_share * total

    def by_shard(schema: str, work) -> DataFrame:
        """``work(shard, row, answers)`` of every shard with what has been answered so far."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            for row in left.to_pylist():
                out += work(row, Answers(right))
            return _rows(out, schema)

        return table.groupBy("shard").cogroup(answers.drop("tokens", "distinct").groupBy("shard")).applyInArrow(run, schema)

    def learned(row: dict, got: Answers, upto: int) -> Shard:
        shard = Shard(row, order)
        for m in range(1, upto + 1):
            shard.learn(m, got, least, head)
        return shard

    for m in range(3, order + 1):
        answers = answers.unionByName(_answered(by_shard(REQUEST, lambda row, got, m=m: learned(row, got, m - 1).request(m, row, bits))))

    def owed(row: dict, got: Answers) -> list[tuple]:
        shard = learned(row, got, order)
        return [r for c in range(1, order) for r in shard.owed(c, row, bits, got, total, vocabulary)]

    if order > 1:
        answers = answers.unionByName(_answered(by_shard(REQUEST, owed)))
    unknown = float(np.log10(ALPHA / (total + ALPHA * (vocabulary + 1))))

    def scored(row: dict, got: Answers) -> list[tuple]:
        shard = learned(row, got, order)
        at = np.flatnonzero(shard.place > 0)
        text, n = shard.owner[at], shard.count[1][at]
        base = np.log10((n + ALPHA) / (total + ALPHA * (vocabulary + 1)))
        texts = len(shard.size)
        return list(zip(shard.docs.tolist(), shard.held.tolist(), shard.size.tolist(), np.bincount(text, n > 0, texts).astype(np.int64).tolist(),
                        np.bincount(text, base, texts).tolist(), shard.read(shard.automaton(got, total, vocabulary), unknown).tolist()))

    return by_shard(SCORED, scored).select(T.public_id(), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
