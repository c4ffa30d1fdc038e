"""Packing: bounded-space online packing of tokenised documents into training sequences.

Every partition keeps a fixed number of open windows.  A document's full windows are emitted as they
are; the rest is placed best-fit, into the open window that it leaves least room in.  When none has
room and no more may be opened, the fullest window is emitted; if it lacks more than ``SLACK``
tokens, the head of the document tops it up first.  What is open when a partition ends is left
over; leftovers are dealt to merge tasks that pack them the same way and finally join their own open
windows end to end, so that a merge task pads one sequence at most.

Token ids are those of a byte-level BPE vocabulary file; ``EOD`` ends every document.  A document
is cut into chunks, white space with the word after it, which such a tokenizer never joins; a task
encodes each different chunk once.

A null or empty text is its end token only.  Rows are packed as often as they are listed, a null id
stays null, other columns are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kestrel.llm import texts as T
from kestrel.session import cut_lineage

LENGTH = 2048
WINDOWS = 64
SLACK = 32
EOD = 1
#: Different chunks held by a task; beyond it starts afresh.
CHUNKS = 400_000
#: Leftover windows that one merge task packs.
MERGE = 4096
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"
#: The split pattern of the vocabulary, and its characters for bytes that don't print.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHUNK = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: White space beside the ASCII kind, whose runs chunks would cut.
WIDE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

#: The bytes that such white space, or a special token, begins with.
LEADS = np.zeros(256, bool)
LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, ord("<")]] = True
BLANK = b"\t\n\x0b\x0c\r "


class Encoder:
    """Token ids of texts, as the vocabulary file's own tokenizer gives them."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        char = {b: chr(b) for b in PRINTED}
        char |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in char)}
        byte = {c: b for b, c in char.items()}
        self.special = [t["content"].encode() for t in vocabulary["added_tokens"]]
        assert all(LEADS[t[0]] for t in self.special), "a special token that texts are not searched for"
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary["model"]["vocab"].items() if t.encode() not in self.special}
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]
        self.bpe = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _learn(self, chunks: set[bytes]) -> None:
        """Encodes new chunks: those of white space and a word in one call, as no token crosses a chunk's edge."""
        plain = [c for c in chunks if c[0] in BLANK and c[-1] not in BLANK]
        ids = np.array(self.bpe.encode_ordinary(b"".join(plain).decode()), np.uint32)
        after = np.cumsum(self.bytes_of[ids])
        stops = np.searchsorted(after, np.cumsum([len(c) for c in plain])) + 1 if plain else np.zeros(0, np.int64)
        rest = [c for c in chunks if c[0] not in BLANK or c[-1] in BLANK]
        alone = [np.array(self.bpe.encode_ordinary(c.decode()), np.uint32) for c in rest]
        sizes = np.concatenate([np.diff(stops, prepend=0), np.array([len(x) for x in alone], np.int64)]).astype(np.int64)
        ids = np.concatenate([ids, *alone])
        k, n, end = len(self.number), len(sizes), self.used + len(ids)
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while k + n > len(self.begin):
            self.begin, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.size))
        self.pool[self.used:end] = ids
        self.size[k:k + n] = sizes
        self.begin[k:k + n] = self.used + np.cumsum(sizes) - sizes
        self.number.update(zip(plain + rest, range(k, k + n)))
        self.used = end

    def _odd(self, raw: bytes) -> bool:
        return WIDE.search(raw) is not None or any(s in raw for s in self.special)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of concatenated texts, each with ``EOD``, and the id offset of each text."""
        texts = [data[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        odd = [self._odd(x) for x in texts] if LEADS[data].any() and self._odd(data.tobytes()) else [False] * len(texts)
        chunks: list[bytes] = []
        count = []
        for x, o in zip(texts, odd):
            found = [] if o else CHUNK.findall(x)
            chunks += found
            count.append(len(found))
        if len(self.number) > CHUNKS:
            self._reset()
        self._learn(set(chunks).difference(self.number))
        number = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        size = self.size[number]
        flat = self.pool[T.expand(self.begin[number], size)]
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        parts = []
        for k, o in enumerate(odd):
            parts.append(np.array(self.whole.encode(texts[k].decode(), add_special_tokens=False).ids, np.uint32) if o else flat[at[k]:at[k + 1]])
            parts.append(np.array([EOD], np.uint32))
        sizes = [len(p) + 1 for p in parts[::2]]
        return np.concatenate(parts) if parts else flat, np.concatenate([[0], np.cumsum(sizes)])


class Packer:
    """Bounded-space best-fit packing of one task's documents; rows are pieces of finished windows."""

    def __init__(self, first_id: int, length: int, windows: int, slack: int, with_ids: bool):
        self.next, self.length, self.windows, self.slack, self.with_ids = first_id, length, windows, slack, with_ids
        self.open: list[tuple[int, int]] = []  # (room, window), least room first
        self.held: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, window: int, pieces: list[tuple], opened: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, window, offset, opened, raw if opened or self.with_ids else None))
            offset += len(ids)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self._emit(self._new(), [(doc, start, ids[:self.length], total)])
            start, ids = start + self.length, ids[self.length:]
        while len(ids):
            k = bisect_left(self.open, (len(ids), -1))
            if k < len(self.open):
                room, window = self.open.pop(k)
            elif len(self.open) < self.windows:
                room, window = self.length, self._new()
            else:
                room, window = self.open.pop(0)
                head = room if room > self.slack else 0
                if head:
                    self.held[window].append((doc, start, ids[:head], total))
                    start, ids = start + head, ids[head:]
                self._emit(window, self.held.pop(window))
                continue
            self.held.setdefault(window, []).append((doc, start, ids, total))
            if room == len(ids):
                self._emit(window, self.held.pop(window))
            else:
                insort(self.open, (room - len(ids), window))
            return

    def leave(self) -> None:
        """Open windows as leftovers, with their ids."""
        for window, pieces in self.held.items():
            self._emit(window, pieces, opened=True)
        self.open, self.held = [], {}

    def join(self) -> None:
        """Open windows end to end into full ones; the last may be short."""
        line, room = [], self.length
        for window in [w for _, w in self.open]:
            for doc, start, ids, total in self.held[window]:
                while len(ids):
                    cut = min(room, len(ids))
                    line.append((doc, start, ids[:cut], total))
                    start, ids, room = start + cut, ids[cut:], room - cut
                    if not room:
                        self._emit(self._new(), line)
                        line, room = [], self.length
        if line:
            self._emit(self._new(), line)
        self.open, self.held = [], {}

    def take(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
        cols = list(zip(*self.rows)) or [()] * 9
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = WINDOWS, slack: int = SLACK,
         with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on request, ids
    (little-endian unsigned 32-bit).  ``tokenizer``: path of the vocabulary file on every machine."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, length, windows, slack, with_ids)
        for batch in batches:
            data, off = T.utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in T.pieces(off):
                tokens, at = encoder.encode(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                for k in range(hi - lo):
                    packer.add(ids[lo + k], 0, tokens[at[k]:at[k + 1]], int(at[k + 1] - at[k]))
                # the windows hold slices; they must not keep the whole stretch alive
                packer.held = {w: [(d, s, i.copy(), n) for d, s, i, n in p] for w, p in packer.held.items()}
                yield packer.take()
        packer.leave()
        yield packer.take()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer((1 << 20) + TaskContext.get().partitionId() << 32, length, windows, slack, with_ids)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
            for doc, start, raw, total in zip(*cols):
                packer.add(doc, start, np.frombuffer(raw, "<u4"), total)
            yield packer.take()
        packer.join()
        yield packer.take()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = cut_lineage(rows.mapInArrow(first, PIECE_SCHEMA))
    left = packed.where("open")
    tasks = max(1, -(-left.where("offset = 0").count() // MERGE))
    merged = (left.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset")
              .mapInArrow(merge, PIECE_SCHEMA))
    out = packed.where("not open").unionByName(merged).drop("open")
    return out if with_ids else out.drop("ids")
