"""Quality rules: a modified Kneser-Ney model per language, and perplexity bands that reject documents.

The model is over symbols, ``LENGTH`` at a time, and holds every n-gram of every text: it grows with the corpus, up to
``SYMBOLS`` ** ``LENGTH`` a language, and no task or driver holds it whole.  White space is one symbol, a language's ``LETTERS`` most frequent characters (by its counts over all
documents, without case and accents) are one each, and any other character is two to four, of which the first tells
how many: no two characters are written alike.  Texts are stored once, in shards of about ``SHARD`` bytes.  A shard sends its distinct n-grams with
their counts, dealt by the two symbols before the last; so what shares a context or an ending of three symbols or more meets in one
bucket.  Buckets add up the counts of all shards; what is shared by all buckets of a language, namely its n-grams of one and two symbols (at most
``SYMBOLS`` ** 2) and its discounts, is summed over them.  A bucket turns its counts into modified Kneser-Ney probabilities (three
discounts an order, continuation counts below the top), kept as sorted hash arrays, and answers each shard in the order asked.

A text's own n-grams would vouch for it, the more so the longer they are.  So a language has two models: the CRC-32 of a text
says which one counts it, and the other one scores it.  Every text is counted and every text is scored, and equal texts are counted by
the same model.  Where the other model has no text, every symbol is as likely as another.

A document's perplexity is taken a letter: all characters are predicted, letters and digits are counted.
(A character's share would fall with every run of marks, whose marks predict each other.)  It is judged
within its language: the band is the median of log2 perplexity
minus ``LOWER`` times its distance to the lower quartile, and plus ``UPPER`` times that to the upper
one, each distance at least ``LEAST_SPREAD``, over all documents that pass the plain rules.  Perplexity
below the band means repetition or filler, above it noise.  The upper band is wider, as good
documents that quote other languages or names form a long upper tail.

Every value of the language column has its models and a band of its own, however few documents it has.  A null
language is the language ''.  A null or empty text has no words and fails; a text without letters counts
as one letter.  ``keep_good`` returns all columns unchanged, whatever their names, ``judge`` its own alone.
Repeated rows are counted and judged like any other.  A text of any length is read whole.  An empty
table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import StructType

from kestrel.llm import hashing as H, texts as T
from kestrel.llm.backoff_lm import _bucketed, _rows, pack, pack_sorted, unpack, unpack_sorted
from kestrel.llm.tally import Tally
from kestrel.session import cut_lineage

SYMBOLS = 64
#: Symbols of an n-gram: of the models of ``judge``, and where a function is not told.
LENGTH, ORDER = 5, 4
#: n-grams of so many symbols are known to all buckets.
SHORT = 2
#: Characters of a language with a symbol of their own, and of the other symbols those that begin a character of two, three and four.
LETTERS, LEADS = 31, (8, 18, 6)
#: Most frequent characters of a language: those of one symbol and of two.
RANKED = LETTERS + LEADS[0] * (SYMBOLS - 1)
LOWER, UPPER = 8.0, 12.0
LEAST_SPREAD = 0.02
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Bins of log2 perplexity.
BINS = 1000
#: Bytes of text in a shard, and per bucket of a language; languages whose symbols a task keeps at hand.
SHARD, TOGETHER, AT_HAND = 8 << 20, 64 << 20, 4
#: Steps of a bit in which values are sent back.
STEPS = 2048
MARKS = np.zeros(256, np.int64)
MARKS[[ord(c) for c in "#*$%&|<>"]] = 1


#: Filled once a process.  (A function wrapped in a cache would be sent to tasks by name, and fail where the package is not installed.)
_POINTS: list[np.ndarray] = []


def _points() -> list[np.ndarray]:
    """Of every code point: itself without case and accents (white space and controls: a space), and whether it is a letter or digit."""
    if not _POINTS:
        plain = np.arange(0x110000, dtype=np.int32)
        for c in range(0x2000):  # the alphabets with case or accents
            plain[c] = 32 if chr(c).isspace() or c < 32 else ord(unicodedata.normalize("NFD", chr(c))[0].lower()[0])
        plain[[0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = 32
        _POINTS.extend([plain, np.array([chr(c).isalnum() for c in range(0x110000)])])
    return _POINTS


def classes(letters: list[int]) -> np.ndarray:
    """Symbols of every code point as digits to the base SYMBOLS, the first the lowest: 0 space, then ``letters`` in order, then all others."""
    more = SYMBOLS - 1  # what follows a first symbol is never a space
    others = np.ones(0x110000, bool)
    others[[32, *letters]] = False
    points = np.concatenate([np.array(letters[LETTERS:], np.int64), np.flatnonzero(others)])
    out, lead, begin = np.zeros(0x110000, np.int32), 1 + LETTERS, 0
    out[letters[:LETTERS]] = np.arange(1, len(letters[:LETTERS]) + 1)
    for k, leads in enumerate(LEADS, 1):
        n = np.arange(min(leads * more ** k, len(points) - begin))
        value = lead + n // more ** k
        for i in range(k):
            value += SYMBOLS ** (i + 1) * (1 + n // more ** (k - 1 - i) % more)
        out[points[begin:begin + len(n)]] = value
        begin, lead = begin + len(n), lead + leads
    return out[_points()[0]]


class Symbols:
    """Symbols of characters by model number in a task, for the last AT_HAND languages."""

    def __init__(self, own: dict[str, list[int]]):
        self.letters, self.known = [[], *own.values()], {}

    def __getitem__(self, slot: int) -> np.ndarray:
        found = self.known.pop(slot, None)
        if found is None:
            found = classes(self.letters[slot])
            if len(self.known) >= AT_HAND:
                del self.known[next(iter(self.known))]
        self.known[slot] = found
        return found


def _characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of concatenated texts and the offset of each text in them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]


def grams(data: np.ndarray, off: np.ndarray, slot: np.ndarray, symbols: Symbols, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram code that ends at each symbol, runs of spaces as one, the code offset of each text, and its number of letters.

    A text is preceded by spaces; ``slot`` is the model number of each.
    """
    points, at = _characters(data, off)
    letters = np.diff(np.concatenate([[0], np.cumsum(_points()[1][points])])[at])
    if len(slot) and (slot == slot[0]).all():
        sym = symbols[int(slot[0])][points]
    else:
        of, sym = np.repeat(slot, np.diff(at)), np.zeros(len(points), np.int32)
        for s in np.unique(of):
            own = np.flatnonzero(of == s)
            sym[own] = symbols[int(s)][points[own]]
    long = np.flatnonzero(sym >= SYMBOLS)
    if len(long):
        width = np.ones(len(sym), np.int64)
        for k in range(1, len(LEADS) + 1):
            width[long] += sym[long] >= SYMBOLS ** k
        ends = np.cumsum(width)
        at = np.concatenate([[0], ends])[at]
        rest, to = sym[long], (ends - width)[long]
        sym = np.repeat(sym, width)
        while len(to):
            sym[to] = rest % SYMBOLS
            rest, to = rest[rest >= SYMBOLS] // SYMBOLS, to[rest >= SYMBOLS] + 1
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0)
    firsts = at[:-1][np.diff(at) > 0]
    keep[firsts] = sym[firsts] > 0
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    sym = sym[keep]
    n = len(at) - 1
    padded = np.zeros(len(sym) + (order - 1) * n, np.int32 if 6 * order < 32 else np.int64)
    of_text = np.ones(len(padded), bool)
    of_text[(at[:-1] + (order - 1) * np.arange(n))[:, None] + np.arange(order - 1)] = False
    padded[of_text] = sym
    code = padded.copy()
    for back in range(1, order):
        code[back:] += padded[:len(padded) - back] << 6 * back
    return code[of_text], at, letters


def measures(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The plain counts of concatenated texts."""
    n = len(off) - 1
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    starts, stops, at = H.words(data, off)
    words = np.diff(at)
    p = H.prefix(H.BYTES[data])
    # words in three-word windows that their text holds twice or more
    x = H.ranges(p, starts, stops)
    ids = np.repeat(np.arange(n), words)
    w = np.flatnonzero(ids[:-2] == ids[2:]) if len(ids) > 2 else np.zeros(0, np.int64)
    q = H.prefix(x)
    _, group, count = np.unique(H.ranges(q, w, w + 3) ^ H.mix(ids[w].astype(np.uint64)), return_inverse=True, return_counts=True)
    edge = np.zeros(len(x) + 1, np.int64)
    twice = w[count[group] > 1]
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 3, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    # lines with a word that equal an earlier line of their text
    cuts = np.flatnonzero(data == 10)
    begin = np.concatenate([off[:-1], cuts + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(off, cuts, side="right") - 1])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.empty(len(begin), np.int64)
    if len(begin):
        end[:-1] = np.where(owner[1:] == owner[:-1], begin[1:] - 1, off[owner[:-1] + 1])
        end[-1] = off[owner[-1] + 1]
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    lines, text = H.ranges(p, begin[worded], end[worded]), owner[worded]
    key = lines ^ H.mix(text.astype(np.uint64) + H.U(7))
    dup = np.ones(len(key), bool)
    dup[np.unique(key, return_index=True)[1]] = False
    return {"n_words": words, "word_chars": per_text(~H.SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_text(MARKS[data]),
            "n_dup_lines": np.bincount(text[dup], minlength=n).astype(np.int64), "n_repeat_words": np.diff(repeated[at])}


def failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def orders(code: np.ndarray, n: np.ndarray, order: int, least: int = 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """n-grams and counts of every order from ``least`` on: below the top, of different symbols before."""
    counts = {order: (code, n.astype(float))}
    for m in range(order - 1, least - 1, -1):
        tail, c = np.unique(counts[m + 1][0] % SYMBOLS ** m, return_counts=True)
        counts[m] = (tail, c.astype(float))
    return counts


def tops(c: np.ndarray) -> np.ndarray:
    """How many n-grams have the counts 1 to 4."""
    return np.array([(c == k).sum() for k in (1, 2, 3, 4)], float)


def discounts(top: np.ndarray) -> np.ndarray:
    """What is taken off the counts 0, 1, 2 and 3 or more."""
    ones, twos, threes, fours = np.maximum(1.0, top)
    y = ones / (ones + 2 * twos)
    return np.array([0, *(np.clip(v, 0.05, k - 0.05) for k, v in ((1, 1 - 2 * y * twos / ones), (2, 2 - 3 * y * threes / twos), (3, 3 - 4 * y * fours / threes)))])


def smooth(code: np.ndarray, n: np.ndarray, order: int = ORDER, off: dict[int, np.ndarray] | None = None, short: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hash array of one language's model from its top-order counts: keys and log2 values.

    Key: 2 * (order << bits | code) for the interpolated probability of an n-gram, plus 1 for the
    weight that a context passes on to shorter ones.  With ``short``, the probabilities of all n-grams of SHORT symbols, and the discounts
    of the longer orders, these alone are made, from the counts of one bucket.
    """
    keys, values, bits = [], [], 6 * order
    least = 1 if short is None else SHORT + 1
    lower = np.full(SYMBOLS, 1 / SYMBOLS) if short is None else short
    lower_codes = np.arange(len(lower))
    for m, (grams_m, c) in sorted(orders(code, n, order, least).items()):
        d = discounts(tops(c)) if off is None else off[m]
        taken = d[np.minimum(c, 3).astype(int)]
        context, inverse = np.unique(grams_m // SYMBOLS, return_inverse=True)
        total = np.bincount(inverse, c)
        passed = np.bincount(inverse, taken) / total
        shorter = lower[np.searchsorted(lower_codes, grams_m % SYMBOLS ** (m - 1))] if m > 1 else lower[grams_m]
        p = (c - taken) / total[inverse] + passed[inverse] * shorter
        keys += [2 * (m << bits | grams_m), 2 * ((m - 1) << bits | context) + 1]
        values += [np.log2(p), np.log2(passed)]
        lower, lower_codes = p, grams_m
    keys, values = np.concatenate(keys), np.concatenate(values)
    by = np.argsort(keys)
    return keys[by].astype(np.uint64), values[by].astype(np.float32)


def log2_probability(model: tuple[np.ndarray, np.ndarray], code: np.ndarray, order: int = ORDER, short: np.ndarray | None = None) -> np.ndarray:
    """log2 probability of the last symbol of each n-gram, by search in the sorted hash array, and in ``short`` if it is of one bucket."""
    keys, values = model
    out, code = np.zeros(len(code)), code.astype(np.int64)
    todo, bits = np.arange(len(code)), 6 * order

    def find(k):
        at = np.minimum(np.searchsorted(keys, k.astype(np.uint64)), max(0, len(keys) - 1))
        return (keys[at] == k.astype(np.uint64), values[at]) if len(keys) else (np.zeros(len(k), bool), np.zeros(len(k)))

    for m in range(order, 0 if short is None else SHORT, -1):
        gram = code[todo] % SYMBOLS ** m
        hit, value = find(2 * (m << bits | gram))
        out[todo[hit]] += value[hit]
        todo, gram = todo[~hit], gram[~hit]
        hit, weight = find(2 * ((m - 1) << bits | gram // SYMBOLS) + 1)
        out[todo[hit]] += weight[hit]
    out[todo] += -np.log2(SYMBOLS) if short is None else np.log2(short)[code[todo] % SYMBOLS ** SHORT]
    return out


def shortest(pairs: np.ndarray) -> np.ndarray:
    """Probabilities of all n-grams of two symbols from the number of different symbols before each."""
    c = pairs.reshape(SYMBOLS, SYMBOLS).astype(float)
    p = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for counts in ((c > 0).sum(0, keepdims=True).astype(float), c):
        taken = discounts(tops(counts))[np.minimum(counts, 3).astype(int)]
        total = counts.sum(1, keepdims=True)
        p = np.where(total > 0, (counts - taken + taken.sum(1, keepdims=True) * p) / np.maximum(total, 1), p)
    return p.ravel()


def _prepared(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[int]]:
    """Every language and its RANKED most frequent characters; the models of number k are those of the k-th, from 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def given():
            for lang, n in held.items():
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(seen) + 1)), pa.array(np.append(seen, 32).astype(np.int32)),
                                                  pa.array(np.append(n[seen], 0))], names=["lang", "point", "n"])
            held.clear()

        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            values = batch.column("lang").dictionary_encode()
            names, number = values.dictionary.to_pylist(), values.indices.to_numpy()
            for lo, hi in T.pieces(off, T.CHUNK // 2):
                points, at = _characters(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                of = np.repeat(number[lo:hi], np.diff(at))
                for k in np.unique(number[lo:hi]):
                    n = np.bincount(_points()[0][points[of == k]])
                    have = held.get(names[k], n[:0])
                    wide = np.zeros(max(len(n), len(have)), np.int64)
                    wide[:len(n)] += n
                    wide[:len(have)] += have
                    held[names[k]] = wide
                if len(held) > AT_HAND:
                    yield from given()
        yield from given()

    counted = (_prepared(docs, lang_col, text_col).mapInArrow(count, "lang string, point int, n long")
               .groupBy("lang", "point").agg(F.sum("n").alias("n")))  # bounded by the code points there are
    first = F.row_number().over(Window.partitionBy("lang").orderBy((F.col("point") == 32).desc(), F.desc("n"), "point"))
    top = counted.withColumn("k", first - 1).where(F.col("k") <= RANKED)
    found = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "point"))).alias("by"))
    return {r.lang: [x.point for x in r.by[1:]] for r in found.orderBy("lang").toLocalIterator()}


def _slots(col: pa.Array, own: dict[str, list[int]]) -> np.ndarray:
    number = {x: k + 1 for k, x in enumerate(own)}
    values = col.dictionary_encode()
    known = np.array([number.get(x, 0) for x in values.dictionary.to_pylist()], np.int64)
    return known[values.indices.to_numpy()] if len(known) else np.zeros(len(col), np.int64)


@dataclass
class Models:
    """Sorted n-grams and their log2 probabilities by model number: ``at`` is a model's place in ``tables``."""

    at: dict[int, int]
    tables: list[tuple[np.ndarray, np.ndarray]]

    def __getitem__(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        return self.tables[self.at[slot]] if slot in self.at else (np.zeros(0, np.int64), np.zeros(0))


class Scorer:
    """Perplexities in a task; holds the values of one language: give it the texts of a batch by language."""

    def __init__(self, models: Models, own: dict[str, list[int]] | Symbols):
        self.models, self.symbols, self.known = models, own if isinstance(own, Symbols) else Symbols(own), {}

    def last(self) -> int:
        return next(iter(self.known), -1)

    def __call__(self, data: np.ndarray, off: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """log2 perplexity a letter; 0 for an empty text.  A language without values has every symbol as likely as another."""
        code, at, letters = grams(data, off, slot, self.symbols, LENGTH)
        of = np.repeat(slot, np.diff(at))
        value = np.full(len(code), -np.log2(SYMBOLS))
        for s in np.unique(of):
            if s not in self.known:
                self.known = {s: self.models[int(s)]}
            keys, found = self.known[s]
            if len(keys):
                mine = np.flatnonzero(of == s)
                by = mine[np.argsort(code[mine])]
                new = np.flatnonzero(np.diff(code[by], prepend=-1))
                value[by] = np.repeat(found[np.searchsorted(keys, code[by[new]])], np.diff(new, append=len(by)))
        total = np.diff(np.concatenate([[0.0], np.cumsum(value)])[at])
        return -total / np.maximum(1, letters)


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _texts(col: pa.ChunkedArray | pa.Array) -> pa.Array:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.fill_null("") if col.null_count else col


def _stored(rows: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``rows`` and their bytes of text, stored by shard: a row is about SHARD bytes of text, of any languages, as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, TaskContext.get().partitionId() << 32

        def shard():
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([_stream(held)], pa.binary())], names=["shard", "rows"])

        for batch in batches:
            _, off = T.utf8(_texts(batch.column(text)))
            for lo, hi in T.pieces(off, SHARD):
                if held and size + off[hi] - off[lo] > SHARD:
                    yield shard()
                    held, size, n = [], 0, n + 1
                held.append(batch.slice(lo, hi - lo))
                size += off[hi] - off[lo]
        if held:
            yield shard()

    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return _bucketed(rows.mapInArrow(run, "shard long, rows binary"), max(16, size // SHARD)), size


def _by_model(table: pa.Table, text: str, own: dict[str, list[int]]) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """A shard's texts by language and by the model that counts them (0 or 1): the numbers of their rows, and the texts."""
    col, slot = _texts(table.column(text)), _slots(table.column("_lang").combine_chunks(), own)
    data, off = T.utf8(col)
    counts = np.array([zlib.crc32(data[lo:hi]) & 1 for lo, hi in zip(off[:-1], off[1:])], np.int64)
    for s, fold in sorted(set(zip(slot.tolist(), counts.tolist()))):
        mine = np.flatnonzero((slot == s) & (counts == fold))
        yield s, fold, mine, col.take(pa.array(mine))


ASKED = "slot long, part long, shard long, fold int, codes binary, n binary"
BUCKET = "slot long, part long, asked binary, codes0 binary, n0 binary, codes1 binary, n1 binary, pairs binary, tops binary"
SHARED = "slot long, pairs binary, tops binary"
ANSWER = "shard long, slot long, fold int, codes binary, steps binary"
FOLDS = (0, 1)


def _asked(shards: DataFrame, text: str, own: dict[str, list[int]], parts: int) -> DataFrame:
    """The distinct n-grams of every shard with their counts there, by language, counting model and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(own)
        for batch in batches:
            for shard, rows in zip(batch.column("shard").to_pylist(), batch.column("rows")):
                for s, fold, _, texts in _by_model(pa.ipc.open_stream(rows.as_buffer()).read_all(), text, own):
                    tally = Tally()
                    data, off = T.utf8(texts)
                    for lo, hi in T.pieces(off, T.CHUNK // 2):
                        code, _, _ = grams(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], np.full(hi - lo, s), symbols, LENGTH)
                        code, n = np.unique(code, return_counts=True)
                        tally.add_counts(code.astype(np.uint64), n)
                    code, n = tally.all()
                    part = (H.mix(code // H.U(SYMBOLS) % H.U(SYMBOLS ** SHORT)) % H.U(parts)).astype(np.int64)
                    out = [(s, p, shard, fold, pack_sorted(code[part == p]), pack(n[part == p])) for p in np.unique(part).tolist()]
                    yield from _rows(out, ASKED).to_batches()

    return shards.mapInArrow(run, ASKED)


def _merged(asked: DataFrame) -> DataFrame:
    """A row per language and bucket: what was asked, the n-grams and counts of both models, and what short n-grams and discounts need of them."""

    def run(key, table):
        tallies = Tally(), Tally()
        for fold, codes, n in zip(*(table.column(c).to_pylist() for c in ("fold", "codes", "n"))):
            tallies[fold].add_counts(unpack_sorted(codes), unpack(n, np.int64))
        both = [t.all() for t in tallies]
        held = [orders(code.astype(np.int64), n, LENGTH, SHORT + 1) for code, n in both]
        pairs = [np.bincount(h[SHORT + 1][0] % SYMBOLS ** SHORT, minlength=SYMBOLS ** SHORT) for h in held]
        top = [[tops(h[m][1]) for m in range(SHORT + 1, LENGTH + 1)] for h in held]
        arrays = [x for code, n in both for x in (pack_sorted(code), pack(n))]
        return _rows([(key[0].as_py(), key[1].as_py(), _stream(table.select(["shard", "fold", "codes"]).to_batches()), *arrays,
                       pack(np.concatenate(pairs)), np.array(top).tobytes())], BUCKET)

    return cut_lineage(asked.groupBy("slot", "part").applyInArrow(run, BUCKET))


def _shared(merged: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, dict[int, np.ndarray]]]:
    """Of every language and model, what all its buckets need: the probabilities of the n-grams of SHORT symbols, and the discounts of longer ones."""

    def run(key, table):
        pairs = sum(unpack(x, np.int64) for x in table.column("pairs").to_pylist())
        top = sum(np.frombuffer(x) for x in table.column("tops").to_pylist())
        return _rows([(key[0].as_py(), pack(pairs), top.tobytes())], SHARED)

    out = {}
    for r in merged.select("slot", "pairs", "tops").groupBy("slot").applyInArrow(run, SHARED).toLocalIterator():  # a row per language
        pairs, top = unpack(r.pairs, np.int64).reshape(len(FOLDS), -1), np.frombuffer(r.tops).reshape(len(FOLDS), -1, 4)
        for fold in FOLDS:
            out[r.slot, fold] = shortest(pairs[fold]), {m: discounts(top[fold][m - SHORT - 1]) for m in range(SHORT + 1, LENGTH + 1)}
    return out


def _answered(merged: DataFrame) -> DataFrame:
    """For every shard, its n-grams and their log2 probabilities by the model that does not count them."""
    shared = merged.sparkSession.sparkContext.broadcast(_shared(merged))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = [unpack_sorted(row[f"codes{fold}"]) for fold in FOLDS]
                steps = []
                for fold in FOLDS:
                    short, off = shared.value[row["slot"], 1 - fold]
                    model = smooth(codes[1 - fold].astype(np.int64), unpack(row[f"n{1 - fold}"], np.int64), LENGTH, off, short)
                    steps.append(np.round(-STEPS * log2_probability(model, codes[fold].astype(np.int64), LENGTH, short)).astype(np.uint32))
                for r in pa.ipc.open_stream(row["asked"]).read_all().to_pylist():
                    found = steps[r["fold"]][np.searchsorted(codes[r["fold"]], unpack_sorted(r["codes"]))]
                    yield from _rows([(r["shard"], row["slot"], r["fold"], r["codes"], pack(found))], ANSWER).to_batches()

    return merged.drop("pairs", "tops").mapInArrow(run, ANSWER)


PLAIN = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _with_scores(rows: DataFrame, text: str, own: dict[str, list[int]], left_out: tuple[str, ...]) -> DataFrame:
    """``rows`` (_lang, ``text``, others) without ``left_out``, with plain counts, base_failed, model number and log2 perplexity."""
    names = [f.split()[0] for f in PLAIN.split(", ")]
    held = [f for f in rows.schema.fields if f.name not in left_out]
    shards, size = _stored(rows, text)
    parts = min(SYMBOLS ** SHORT, 4 << (size // TOGETHER).bit_length())
    answers = _answered(_merged(_asked(shards, text, own, parts)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answered: dict[tuple[int, int], list] = {}
        for r in right.to_pylist():
            answered.setdefault((r["slot"], r["fold"]), []).append((unpack_sorted(r["codes"]), unpack(r["steps"], np.uint32)))
        symbols, out = Symbols(own), []
        for stream in left.column("rows"):
            table = pa.ipc.open_stream(stream.as_buffer()).read_all()
            n = table.num_rows
            found = {c: np.zeros(n, np.int64) for c in names} | {"base_failed": np.zeros(n, bool), "slot": np.zeros(n, np.int64), "log2_ppl": np.zeros(n)}
            for s, fold, mine, texts in _by_model(table, text, own):
                scorer = Scorer(Models({s: 0}, [_sorted(answered.pop((s, fold), []))]), symbols)
                found["slot"][mine] = s
                data, off = T.utf8(texts)
                for lo, hi in T.pieces(off, T.CHUNK // 8):
                    part, at, to = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], mine[lo:hi]
                    m = measures(part, at)
                    for c in names:
                        found[c][to] = m[c]
                    found["base_failed"][to], found["log2_ppl"][to] = failed(m), scorer(part, at, np.full(hi - lo, s))
            out.append(pa.table([*(table.column(f.name) for f in held), *map(pa.array, found.values())], names=[*(f.name for f in held), *found]))
        return pa.concat_tables(out)

    added = StructType.fromDDL(PLAIN + ", base_failed boolean, slot long, log2_ppl double")
    return cut_lineage(shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, StructType(held + added.fields)))


def _sorted(answered: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all buckets in order, and their log2 probabilities."""
    if not answered:
        return np.zeros(0, np.int64), np.zeros(0)
    codes, steps = (np.concatenate(x) for x in zip(*answered))
    by = np.argsort(codes)
    return codes[by].astype(np.int64), steps[by] / -STEPS


def bands(scored: DataFrame, lower: float = LOWER, upper: float = UPPER) -> dict[int, tuple[float, float]]:
    """Model number to the least and greatest log2 perplexity that is kept, in steps of 1 / BINS."""
    bins = (scored.where("not base_failed").groupBy("slot", F.round(F.col("log2_ppl") * BINS).cast("long").alias("bin")).agg(F.count("*").alias("n")))

    def band(key, table):  # the bins of one language, of a bounded range
        table = table.sort_by("bin")
        at, cum = table["bin"].to_numpy() / BINS, np.cumsum(table["n"].to_numpy())
        low, mid, high = (at[np.searchsorted(cum, q * cum[-1])] for q in (0.25, 0.5, 0.75))
        limits = mid - lower * max(LEAST_SPREAD, mid - low), mid + upper * max(LEAST_SPREAD, high - mid)
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "low": pa.array([limits[0]]), "high": pa.array([limits[1]])})

    found = bins.groupBy("slot").applyInArrow(band, "slot long, low double, high double")
    return {r.slot: (r.low, r.high) for r in found.toLocalIterator()}  # a row per language


def rejected(scored: DataFrame, limits: dict[int, tuple[float, float]]) -> DataFrame:
    """``scored`` with the verdict ``kept``."""
    rows = [(s, float(a), float(b)) for s, (a, b) in limits.items()]
    held = scored.sparkSession.createDataFrame(rows, "slot long, low double, high double")
    inside = F.col("log2_ppl").between(F.col("low"), F.col("high"))
    return (scored.join(F.broadcast(held), "slot", "left")  # a row per language
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))))


def _lang(docs: DataFrame, lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang")


def judge(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """A row per document: its counts, log2 perplexity, band and verdict."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _lang(docs, lang_col), F.col(text_col).alias("_text"))
    scored = _with_scores(rows, "_text", languages(docs, lang_col, text_col), ("_lang", "_text"))
    return rejected(scored, bands(scored, lower, upper))


def keep_good(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """The documents that the rules keep, with all their columns.  Rows are scored once and written with their scores."""
    rows = docs.select(*(F.col(c).alias(f"_in{i}") for i, c in enumerate(docs.columns)), _lang(docs, lang_col))
    scored = _with_scores(rows, f"_in{docs.columns.index(text_col)}", languages(docs, lang_col, text_col), ("_lang",))
    return rejected(scored, bands(scored, lower, upper)).where("kept").select(*T.restored(docs).values())
