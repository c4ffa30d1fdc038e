"""Conversation structure repair: the cheapest edits that give a conversation the form (system? (user assistant)+)?.

A row is *blank* (no text), a *duplicate* (role and text seen earlier in its conversation) or *truncated* (its text does
not end in ``.``, ``!`` or ``?``); the first of these that holds is its fault.  Edits, by initial: Keep (cost 0), Rerole to user or
assistant (3), Delete (4, the only choice for blank and duplicate rows) and Insert of an empty user or assistant turn anywhere
(3).  A truncated row that stays adds 3.  Among the cheapest the audit, the initials in order, that is least in ASCII counts.

A conversation is a string over nine symbols (role initial and fault).  The strings of all conversations are compressed
by one Re-Pair grammar, built in rounds: Spark counts the adjacent pairs over the distinct strings with their multiplicity, and
a round replaces the most frequent pair with all others that cannot overlap it.  Each symbol has a min-plus matrix over the four
states of the form (start, after system, after user, after assistant): cost and audit of the cheapest way from one state to another.
A rule's matrix is the product of its two sides', evaluated bottom-up once; its audits are ropes of theirs.  What is left of a
conversation after compression is multiplied symbol by symbol.  Equal costs are decided by the audits' first difference: audits of one stretch and one cost never are
prefixes of each other, as each further insert costs, so the choice holds whatever follows.

The grammar is bounded (``ROUNDS`` x ``PAIRS`` rules) and therefore broadcast; rules left out change no result.  Strings are cut into pieces of
``PIECE`` symbols.  The repaired text's digest is sequential by definition: one conversation is one task's stream, in bounded memory but for its audit.

Rows come by turn, nulls first; rows of one turn by role and then by a hash of the text.  A null role or text is one space (so the row is
blank, or of no known role); a null conversation id is a conversation of its own.  Repeated rows are duplicates.  Other columns are left out, so no name can clash.
Texts are read whole.  A conversation without rows, given by ``ids``, needs no edits; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrel.session import cut_lineage

BLANK = " \t\n\x0b\x0c\r"
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
RETYPE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: Symbols: 0 must go; 1-4 a sound row of s, u, a or another initial; 5-8 the same, truncated.
SYMBOLS = 9
PIECE = 4096
ROUNDS = 24
PAIRS = 1024
#: A round that would shorten the strings, as first given, by less than this share ends the grammar.
GAIN = 0.01
#: Audits up to this length are held as text, longer ones as ropes.
LEAF = 256
HELD = 20_000
BIG = 1 << 32
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
PIECE_SCHEMA = "conv_id long, piece long, seq string, counts array<long>"
RESULT_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# ---- ropes and matrices -------------------------------------------------------------------------------------------

def leaves(rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top[1], top[0])


def joined(a, b):
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= LEAF:
        return a + b
    return b if a == "" else a if b == "" else (a, b)


def less(a, b) -> bool:
    """Whether rope ``a`` reads before rope ``b``."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    one, two = leaves(a), leaves(b)
    x = y = ""
    while True:
        x, y = x or next(one, None), y or next(two, None)
        if x is None or y is None:
            return x is None and y is not None
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x < y
        x, y = x[n:], y[n:]


def times(a: list, b: list) -> list:
    """Min-plus product of two matrices of (cost, audit), row by row; None where there is no way."""
    out = [None] * (len(a) // STATES * STATES)
    for p in range(len(a) // STATES):
        for r in range(STATES):
            left = a[p * STATES + r]
            if left is None:
                continue
            for q in range(STATES):
                right = b[r * STATES + q]
                if right is None:
                    continue
                cost, k = left[0] + right[0], p * STATES + q
                if out[k] is None or cost <= out[k][0]:
                    audit = joined(left[1], right[1])
                    if out[k] is None or cost < out[k][0] or less(audit, out[k][1]):
                        out[k] = cost, audit
    return out


NEXT = {START: (USER, None), SYSTEM: (USER, None), USER: (None, ASSISTANT), ASSISTANT: (USER, None)}


def inserts(p: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, audit) by inserts alone; a third one never helps."""
    cost, audit = 0, ""
    for _ in range(3):
        yield p, cost, audit
        p = next(q for q in NEXT[p] if q is not None)
        cost, audit = cost + INSERT, audit + "I"


def symbol_matrix(symbol: int) -> list:
    """One row, after any inserts before it."""
    ways: list = [None] * STATES ** 2
    initial = None if symbol == 0 else "suao"[(symbol - 1) % 4]
    late = CUT_SHORT if symbol > 4 else 0
    for p in range(STATES):
        for r, cost, audit in inserts(p):
            steps = [(r, DELETE, "D")]
            if symbol:
                steps += [(q, RETYPE + late, "R") for q in NEXT[r] if q is not None]
                kept = {"s": SYSTEM if r == START else None, "u": NEXT[r][0], "a": NEXT[r][1]}.get(initial)
                if kept is not None:
                    steps.append((kept, late, "K"))
            for q, more, edit in steps:
                way, k = (cost + more, audit + edit), p * STATES + q
                if ways[k] is None or way < ways[k]:
                    ways[k] = way
    return ways


def finished(row: list) -> tuple[int, str]:
    """The best end of a conversation: no turn at all, or after an assistant, by inserts if need be."""
    best = None
    for p in range(STATES):
        for q, cost, audit in inserts(p):
            if row[p] is not None and (q == ASSISTANT or (q == START and p == START)):
                way = row[p][0] + cost, joined(row[p][1], audit)
                if best is None or way[0] < best[0] or (way[0] == best[0] and less(way[1], best[1])):
                    best = way
    return best[0], "".join(leaves(best[1]))


# ---- the grammar --------------------------------------------------------------------------------------------------

def matches(x: np.ndarray, same: bool) -> np.ndarray:
    """The code of the pair that begins at each place, -1 for none; of a run of one symbol every second pair."""
    code = np.where((x[:-1] >= 0) & (x[1:] >= 0), x[:-1] * BIG + x[1:], -1)
    twin = x[:-1] == x[1:]
    if not same:
        return np.where(twin, -1, code)
    head = np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1]), np.arange(len(x)), 0))[:-1]
    return np.where(twin & ((np.arange(len(x) - 1) - head) % 2 == 0), code, -1)


def compress(x: np.ndarray, rounds: list[tuple[bool, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Symbol strings, each ended by -1, after all rounds of replacement."""
    for same, codes, new in rounds:
        if len(x) < 2:
            break
        code = matches(x, same)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[at] == code
        keep = np.ones(len(x), bool)
        keep[1:] = ~hit
        x = x.copy()
        x[:-1][hit] = new[at[hit]]
        x = x[keep]
    return x


def flat(seqs: list[str]) -> np.ndarray:
    raw = np.frombuffer(("\n".join(seqs) + "\n").encode(), np.uint8).astype(np.int64)
    return np.where(raw == 10, -1, raw - 48)


def pair_counts(strings: DataFrame, rounds: list) -> DataFrame:
    """(pair, times) over all distinct strings, counted with their multiplicity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = compress(flat(batch.column(0).to_pylist()), rounds)
            weight = batch.column(1).to_numpy()[np.cumsum(x < 0)[:-1].clip(max=len(batch) - 1)] if len(x) > 1 else np.zeros(0, np.int64)
            if not len(weight):
                continue
            for same in (False, True):
                code = matches(x, same)
                on = code >= 0
                pair, back = np.unique(code[on], return_inverse=True)
                n = np.bincount(back, weights=weight[on], minlength=len(pair)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "times"])

    return strings.select("seq", "n").mapInArrow(run, "pair long, times long").groupBy("pair").agg(F.sum("times").alias("times"))


def build_grammar(strings: DataFrame, most_rounds: int = ROUNDS, most_pairs: int = PAIRS) -> tuple[list, list]:
    """(rounds, matrices) of the strings (seq, n): what ``compress`` replaces, and the matrix of every symbol and rule."""
    rounds: list = []
    matrices = [symbol_matrix(s) for s in range(SYMBOLS)]
    total = strings.agg(F.sum(F.col("n") * F.length("seq"))).first()[0] or 0
    for _ in range(most_rounds):
        counted = pair_counts(strings, rounds).where("times > 1").orderBy(F.desc("times"), "pair").limit(most_pairs).collect()
        found = {(r[0] // BIG, r[0] % BIG): r[1] for r in counted}
        if not found:
            break
        first = next(iter(found))
        same = first[0] == first[1]
        chosen, lefts, rights = [], set(), set()
        for a, b in [first] if same else found:
            if same or (a != b and a not in rights and b not in lefts):
                chosen.append((a, b))
                lefts.add(a)
                rights.add(b)
        if sum(found[c] for c in chosen) < GAIN * total:
            break
        chosen.sort()
        rounds.append((same, np.array([a * BIG + b for a, b in chosen]), np.arange(len(chosen)) + len(matrices)))
        matrices += [times(matrices[a], matrices[b]) for a, b in chosen]
    return rounds, matrices


def product(symbols: list[int], matrices: list) -> list:
    if len(symbols) == 1:
        return matrices[symbols[0]]
    half = len(symbols) // 2
    return times(product(symbols[:half], matrices), product(symbols[half:], matrices))


class Chain:
    """Matrices multiplied in order, as a balanced tree."""

    def __init__(self):
        self.stack: list[tuple[int, list]] = []

    def add(self, matrix: list) -> None:
        level = 0
        while self.stack and self.stack[-1][0] == level:
            matrix, level = times(self.stack.pop()[1], matrix), level + 1
        self.stack.append((level, matrix))

    def best(self) -> tuple[int, str]:
        row: list = [(0, "")] + [None] * (STATES - 1)
        for _, matrix in self.stack:
            row = times(row, matrix)
        return finished(row)


# ---- Spark ----------------------------------------------------------------------------------------------------------

def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn``, as test cases for ``repair``; nulls become one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                     (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("_hit"))
    hit = F.col("_hit")
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.where(hit != 0).select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _pieces(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, seq, counts): every conversation's symbols in order; no text leaves the scan."""
    ended = F.rtrim(F.col("text"), F.lit(BLANK))
    slim = rows.select("conv_id", "turn", "role", "hash", (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    one = slim.groupBy("conv_id", "turn", "role", "hash", "blank", "cut").agg(F.count(F.lit(1)).alias("copies"))
    rank = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # nulls first
    said = (one.groupBy("conv_id", "role", "hash").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
            .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "first"))
    met = one.join(said, one["conv_id"].eqNullSafe(said["c"]) & (one["role"] == said["r"]) & (one["hash"] == said["h"]), "left")
    again = F.coalesce(rank > F.col("first"), F.lit(False)) & ~F.col("blank")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    symbol = F.when(F.col("blank") | again, 0).when(F.col("cut"), place + 4).otherwise(place)
    told = met.select("conv_id", "turn", "role", "hash", initial.alias("initial"), "blank", again.alias("again"), symbol.alias("symbol"), "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, begun = None, False
        seq, size, piece, counts, before, turns = [], 0, 0, [0] * 5, "", [None, None, 0]

        def emit(last: bool):
            nonlocal seq, size, piece, counts
            if last and turns[2]:
                counts[0] = turns[1] - turns[0] + 1 - turns[2]
            out.append((conv, piece, "".join(seq), counts))
            seq, size, piece, counts = [], 0, piece + 1, [0] * 5

        for batch in batches:
            for c, turn, initial, blank, again, symbol, copies in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "initial", "blank", "again", "symbol", "copies"))):
                if not begun or c != conv:
                    if begun:
                        emit(True)
                    conv, begun, piece, before, turns = c, True, 0, "", [None, None, 0]
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                counts[1] += copies if blank else 0
                counts[2] += 0 if blank else copies if again else copies - 1
                counts[3] += symbol > 4
                counts[4] += copies - 1 + (piece + size > 0 and before + initial not in ("su", "ua", "au"))
                before = initial
                todo, mark = copies, str(symbol)
                while todo:
                    if size == PIECE:
                        emit(False)
                    n = 1 if mark != "0" else min(todo, PIECE - size)
                    seq.append(mark * n)
                    size, todo, mark = size + n, todo - n, "0"
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))], ["conv_id", "piece", "seq", "counts"])
                out = []
        if begun:
            emit(True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))], ["conv_id", "piece", "seq", "counts"])

    return told.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "hash").mapInArrow(run, PIECE_SCHEMA)


class Writer:
    """The repaired conversation, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.said, self.led = audit, 0, 0, 0
        self.sha = hashlib.sha256()

    def say(self, role: str | None, text: str) -> None:
        if role is None:
            role = "assistant" if (self.said - self.led) % 2 else "user"
        self.sha.update((("\n" if self.said else "") + f"{role}:{text}").encode())
        self.said += 1

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.say(None, "")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.led += role[:1] == "s"
            self.say(role, text)
        elif edit == "R":
            self.say(None, text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def repair(turns: DataFrame, ids: DataFrame | None = None, most_rounds: int = ROUNDS, most_pairs: int = PAIRS) -> DataFrame:
    """(conv_id, counts of faults, cost, audit, repaired_sha256) of every conversation of ``turns`` and ``ids``."""
    spark = turns.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.withColumn("hash", F.unhex(F.sha2("text", 256)))
    pieces = cut_lineage(_pieces(rows))
    strings = cut_lineage(pieces.groupBy("seq").agg(F.count(F.lit(1)).alias("n")))
    shared = spark.sparkContext.broadcast(build_grammar(strings, most_rounds, most_pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, matrices = shared.value
        known: dict[str, list] = {}
        out: list[tuple] = []
        conv, begun, counts, chain, cost, writer = None, False, [0] * 5, None, 0, None

        def start():
            nonlocal cost, writer
            cost, audit = chain.best()
            writer = Writer(audit)

        def end():
            if writer is None:
                start()
            out.append((conv, *counts, cost, writer.audit, writer.digest()))

        for batch in batches:
            kinds, seqs = batch.column("kind").to_pylist(), batch.column("seq").to_pylist()
            new = list({s for k, s in zip(kinds, seqs) if k == 1 and s not in known})
            if len(known) > HELD:
                known, new = {}, list({s for k, s in zip(kinds, seqs) if k == 1})
            if new:
                x = compress(flat(new), rounds)
                for s, part in zip(new, np.split(x, np.flatnonzero(x < 0) + 1)):
                    known[s] = product(part[:-1].tolist(), matrices)
            for c, kind, s, more, role, text in zip(batch.column("conv_id").to_pylist(), kinds, seqs, batch.column("counts").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if not begun or c != conv:
                    if begun:
                        end()
                    conv, begun, counts, chain, cost, writer = c, True, [0] * 5, Chain(), 0, None
                if kind == 1:
                    counts = [a + b for a, b in zip(counts, more)]
                    chain.add(known[s])
                elif kind == 2:
                    if writer is None:
                        start()
                    writer.row(role, text)
            if out:
                yield _table(out)
                out = []
        if begun:
            end()
            yield _table(out)

    none = lambda t: F.lit(None).cast(t)
    plan = "long", "string", "array<long>", "long", "string", "binary", "string"
    names = "piece", "seq", "counts", "turn", "role", "hash", "text"
    stream = (pieces.select("conv_id", F.lit(1).alias("kind"), "piece", "seq", "counts", *[none(t).alias(n) for n, t in list(zip(names, plan))[3:]])
              .unionByName(rows.select("conv_id", F.lit(2).alias("kind"), *[none(t).alias(n) for n, t in list(zip(names, plan))[:3]], "turn", "role", "hash", "text")))
    if ids is not None:
        stream = stream.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.lit(0).alias("kind"), *[none(t).alias(n) for n, t in zip(names, plan)]))
    return (stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "piece", "turn", "role", "hash").mapInArrow(run, RESULT_SCHEMA))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"])
