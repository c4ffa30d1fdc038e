"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record's nested field paths (``messages[].role``), restricted to the fields that any mapping
speaks of, are sorted and hashed; the hash selects the mapping.  A typed table has one fingerprint, a
column of JSON records has one for every row.  Mappings say which list or which fields are the turns;
they become column expressions, so no layout has code of its own.

The template writes a turn as ``<|turn|>ROLE\\nTEXT<|end|>\\n``.  Inside roles and texts a backslash is
doubled and a control string gets one after its first character, so reading back is exact.  The loss mask
is the span of each assistant text in the formatted conversation, in characters.

Role names of other layouts (``human``, ``gpt`` ...) become the canonical ones; rows that are turns already
keep theirs.  Turns of a conversation are ordered by turn, then role, then text; a null turn comes first, a
repeated row is a turn of its own.  A null text or role is empty.  A record without a conversation id is a conversation
of its own, known by its place in the input (``record``; null where there is an id); single rows with a null conversation id
are one conversation, as nothing else tells which belong together.  Records without a mapping, and broken JSON, are returned by ``unmapped``.  Columns that no
mapping speaks of are left out.  An empty table gives an empty result.  Formatting a turn needs no other
turn; offsets and digests are sums along a conversation and are streamed through one task in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DataType, StructType

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Strings that a text must not be able to forge.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Each:
    """Every element of a list is a turn."""

    path: str
    role: str
    text: str


@dataclass(frozen=True)
class One:
    """One field is a turn of a fixed role; a null field is no turn, further fields follow after a line end."""

    role: str
    path: str
    more: tuple[str, ...] = ()


def _element(p: Each):
    return lambda x: F.struct(x[p.role].alias("role"), x[p.text].alias("text"))


@dataclass(frozen=True)
class Mapping:
    name: str
    parts: tuple[Each | One, ...]
    key: str = "conv_id"
    optional: tuple[str, ...] = ()
    #: A row is a turn itself: its fields for turn, role and text.
    row: tuple[str, str, str] | None = None
    paths: frozenset[str] = field(init=False)

    def __post_init__(self):
        own = {self.key, *(self.row or ())}
        for p in self.parts:
            own |= {f"{p.path}[].{p.role}", f"{p.path}[].{p.text}"} if isinstance(p, Each) else {p.path, *p.more}
        object.__setattr__(self, "paths", frozenset(own))

    def fingerprints(self) -> list[str]:
        """One for every choice of optional fields."""
        sets = [self.paths.difference(c) for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [digest(s) for s in sets]

    def ddl(self) -> str:
        fields = {self.key: "long"}
        for p in self.parts:
            fields |= {p.path: f"array<struct<`{p.role}`:string,`{p.text}`:string>>"} if isinstance(p, Each) else {q: "string" for q in (p.path, *p.more)}
        return ", ".join(f"`{k}` {v}" for k, v in fields.items())

    def turns(self, at) -> Column:
        """array<struct<role, text>> of a record; ``at`` gives the column of a top-level field."""
        lists = []
        for p in self.parts:
            if isinstance(p, Each):
                lists.append(F.coalesce(F.transform(at(p.path), _element(p)), F.array().cast(TURNS)))
            else:
                # an empty further field adds nothing
                text = F.concat_ws("\n", at(p.path), *(F.when(at(q) != "", at(q)) for q in p.more))
                lists.append(F.when(at(p.path).isNull(), F.array().cast(TURNS)).otherwise(F.array(F.struct(F.lit(p.role).alias("role"), text.alias("text"))).cast(TURNS)))
        return F.concat(*lists)


TURNS = "array<struct<role:string,text:string>>"
MAPPINGS = (
    Mapping("rows", (), row=("turn", "role", "text")),
    Mapping("messages", (One("system", "system"), Each("messages", "role", "content")), optional=("system", "conv_id")),
    Mapping("shares", (Each("conversations", "from", "value"),), optional=("conv_id",)),
    Mapping("pairs", (One("system", "system"), One("user", "prompt"), One("assistant", "response")), optional=("system", "conv_id")),
    Mapping("tasks", (One("user", "instruction", ("input",)), One("assistant", "output")), optional=("input", "conv_id")),
)


def digest(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


KNOWN = frozenset().union(*(m.paths for m in MAPPINGS))
BY_FINGERPRINT = {f: m.name for m in MAPPINGS for f in m.fingerprints()}


def type_paths(kind: DataType, at: str = "") -> set[str]:
    """Paths of the scalar fields of a typed table."""
    if isinstance(kind, StructType):
        return set().union(*(type_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind)) if len(kind) else set()
    return type_paths(kind.elementType, at + "[]") if isinstance(kind, ArrayType) else {at}


def variant_paths(schema: str) -> set[str]:
    """The same, from the schema text of a JSON record."""
    found: set[str] = set()
    stack, name, i = [], "", 0
    token = re.compile(r"(OBJECT|ARRAY)<|`((?:[^`]|``)*)`: |([^<>:,`]+): |[^<>:,` ]+(?:\([\d,]+\))?|[>, ]")
    prefix = ""
    while i < len(schema):
        m = token.match(schema, i)
        if not m:
            return set()
        i = m.end()
        if m[1] == "OBJECT":
            stack.append(prefix)
        elif m[1] == "ARRAY":
            stack.append(prefix)
            prefix += "[]"
        elif m[2] is not None or m[3] is not None:
            name = (m[2].replace("``", "`") if m[2] is not None else m[3]).strip()
            prefix = f"{stack[-1]}.{name}" if stack[-1] else name
        elif m[0] == ">":
            prefix = stack.pop()
        elif m[0] not in ", ":
            found.add(prefix)
    return found


def fingerprint(schema: StructType) -> str:
    return digest(type_paths(schema) & KNOWN)


def _layout_of(schema: str | None) -> str | None:
    return None if schema is None else digest(variant_paths(schema) & KNOWN)


def record_fingerprints(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` with the fingerprint and layout of every JSON record; null where it is no JSON."""

    @pandas_udf("string")
    def marked(schema):
        found = {s: _layout_of(s) for s in schema.dropna().unique()}
        return pd.Series([found.get(s) for s in schema], dtype=object)

    layout = F.lit(None).cast("string")
    with_print = records.withColumn("fingerprint", marked(F.schema_of_variant(F.try_parse_json(json_col))))
    for name in {m.name for m in MAPPINGS if m.row is None}:
        own = [f for f, n in BY_FINGERPRINT.items() if n == name]
        layout = F.when(F.col("fingerprint").isin(own), F.lit(name)).otherwise(layout)
    return with_print.withColumn("layout", layout)


def unmapped(records: DataFrame, json_col: str = "record") -> DataFrame:
    return record_fingerprints(records, json_col).where("layout is null")


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for a, b in ROLES.items():
        out = F.when(role == a, b).otherwise(out)
    return out


def _exploded(records: DataFrame) -> DataFrame:
    """Rows (conv_id, record, turn, role, text) of (conv_id, turns)."""
    place = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("record")
    return (records.select("conv_id", place, "turns").select("conv_id", "record", F.posexplode("turns").alias("turn", "t"))
            .select("conv_id", "record", F.col("turn").cast("long").alias("turn"), _role(F.col("t.role")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text")))


def turns_of_records(records: DataFrame, json_col: str = "record") -> DataFrame:
    """Canonical turns of JSON records of any mapped layouts, in one pass."""
    marked = record_fingerprints(records, json_col)
    key, turns = F.lit(None).cast("long"), F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        if m.row is None:
            parsed = F.from_json(json_col, m.ddl())
            is_it = F.col("layout") == m.name
            key = F.when(is_it, parsed[m.key]).otherwise(key)
            turns = F.when(is_it, m.turns(lambda c, p=parsed: p[c])).otherwise(turns)
    return _exploded(marked.where("layout is not null").select(key.alias("conv_id"), turns.alias("turns")))


def turns_of_table(table: DataFrame) -> DataFrame:
    """Canonical turns of a typed table whose fingerprint has a mapping."""
    name = BY_FINGERPRINT.get(fingerprint(table.schema))
    if name is None:
        raise ValueError(f"no mapping for the layout {sorted(type_paths(table.schema))}")
    m = next(m for m in MAPPINGS if m.name == name)
    if m.row:
        turn, role, text = m.row
        return table.select(F.col(m.key).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("record"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                            F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.col(m.key).cast("long") if m.key in table.columns else F.lit(None).cast("long")
    return _exploded(table.select(key.alias("conv_id"), m.turns(lambda c: F.col(c) if c in table.columns else F.lit(None).cast("string")).alias("turns")))


def escaped(text: Column) -> Column:
    """Every backslash doubled, and one after the first character of every control string."""
    first = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({first})", r"$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(turns: DataFrame) -> DataFrame:
    """A row per turn: conv_id, record, place, segment, offset in the conversation, loss_start and loss_stop (null: no loss)."""
    # in a role a line end is escaped too, as it ends the role
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    body = escaped(F.col("text"))
    by_turn = Window.partitionBy("conv_id", "record").orderBy("turn", "role", "text")
    before = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    made = (turns.withColumn("segment", F.concat(head, body, F.lit(CLOSE + "\n")))
            .withColumn("head", F.length(head)).withColumn("body", F.length(body))
            .withColumn("place", F.row_number().over(by_turn) - 1)
            .withColumn("offset", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0).cast("long"))))
    learnt = F.col("role") == "assistant"
    start = F.col("offset") + F.col("head")
    return made.select("conv_id", "record", "place", "segment", "offset", F.when(learnt, start).alias("loss_start"), F.when(learnt, start + F.col("body")).alias("loss_stop"))


_SEGMENT = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(CLOSE) + "\n", re.S)


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    m = _SEGMENT.fullmatch(segment)
    return unescaped(m[1]), unescaped(m[2])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them, a row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def close():
            if state:
                n, turns, chars, loss, total = state
                done.append((key[0], n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def out():
            names = [f.split()[0] for f in DIGEST.split(", ")]
            cols = list(zip(*done)) or [()] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if "sha" in f else pa.int64()) for c, f in zip(cols, names)], names=names)

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("conv_id", "record", "segment", "offset", "loss_start", "loss_stop"))
            for conv, record, segment, offset, start, stop in zip(*cols):
                if state is None or (conv, record) != key:
                    close()
                    key, state = (conv, record), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learnt = unescaped(segment[start - offset:stop - offset])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(segment)
            yield out()
        close()
        yield out()

    return segments.repartition("conv_id", "record").sortWithinPartitions("conv_id", "record", "place").mapInArrow(run, DIGEST)
