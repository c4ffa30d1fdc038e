"""The words of ``text.tokens`` (F9) for a whole Arrow batch at once, on its UTF-8 bytes.

``plain`` says which lower-cased texts this is for: those of Latin letters up to U+024F and the general punctuation up to U+206F, whose classes
no Unicode version changes, and without the words that ``tokens`` takes apart.  All others are left to ``tokens`` itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.functions.text import JOINED, SINGLE_MARKS, SPACES

BEYOND = r"[^\x00-\x{24F}\x{2000}-\x{206F}]"
TOP = 0x2070
#: Bytes of text that are looked at together.
PIECE = 4 << 20
OTHER, SPACE, LETTER, DIGIT, QUOTE, DOT, DASH, COMMA = range(8)
#: Filled once a process.
_TABLES: list = []


def plain(lowered: Column) -> Column:
    """Whether ``words`` may split the lower-cased text; null for a null text."""
    return ~(lowered.rlike(BEYOND) | reduce(lambda a, b: a | b, [lowered.contains(w) for w in JOINED]))


def _tables() -> list:
    """(class of every byte of ASCII, class of every code point below TOP, pattern of a word with apostrophes)."""
    if not _TABLES:
        kinds = np.zeros(TOP, np.uint8)
        letters = [c for c in range(0x250) if unicodedata.category(chr(c))[0] == "L"]
        kinds[letters] = LETTER
        kinds[[ord(c) for c in SINGLE_MARKS + SPACES if ord(c) < TOP]] = SPACE
        kinds[[ord(c) for c in " '.-,:"]] = [SPACE, QUOTE, DOT, DASH, COMMA, COMMA]
        kinds[ord("0"):ord("9") + 1] = DIGIT
        letter = f"[{''.join(map(chr, letters))}]"
        word = re.compile(rf"('*+)({letter}+)(?:n't|'(?:s|m|d|ll|re|ve))?'*+\.?")
        _TABLES.extend([np.append(kinds[:128], np.zeros(128, np.uint8)), kinds, word])
    return _TABLES


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of every byte, that of its character; marks that come apart are spaces."""
    ascii_kinds, kinds, _ = _tables()
    kind = ascii_kinds[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        three = data[lead] >= 0xE0
        for at, size in ((lead[~three], 2), (lead[three], 3)):
            point = data[at].astype(np.int32) & (0x1F if size == 2 else 0x0F)
            for k in range(1, size):
                point = point << 6 | (data[at + k] & 0x3F)
            for k in range(size):
                kind[at + k] = kinds[point]
    for mark in (DOT, DASH):  # runs of dots, and pairs of dashes
        at = np.flatnonzero(kind == mark)
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            size = np.diff(np.append(first, len(at)))
            gone = np.where(size > 1, size, 0) if mark == DOT else size // 2 * 2
            kind[at[np.arange(len(at)) - np.repeat(first, size) < np.repeat(gone, size)]] = SPACE
    comma = np.flatnonzero(kind == COMMA)  # a text ends with a space: something follows
    kind[comma[kind[comma + 1] != DIGIT]] = SPACE
    return kind


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The strings between the places, which do not touch."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    held = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    off = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(off), pa.py_buffer(held))


def _piece(data: np.ndarray, off: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    kind = _kinds(data)
    space = np.concatenate([[True], kind == SPACE])
    turn = np.flatnonzero(space[1:] != space[:-1])  # where chunks begin and end, in turns
    starts, ends = turn[::2], turn[1::2].copy()
    # what is no letter: only a dot at the end, or an apostrophe, may be in a chunk with a word
    bad = np.flatnonzero((kind != LETTER) & (kind != SPACE))
    of = np.searchsorted(starts, bad, side="right") - 1
    n_bad = np.bincount(of, minlength=len(starts))
    last_dot = np.zeros(len(starts), bool)
    last_dot[of[(kind[bad] == DOT) & (bad == ends[of] - 1)]] = True
    quoted = np.zeros(len(starts), bool)
    quoted[of[kind[bad] == QUOTE]] = True
    keep = (n_bad == 0) | ((n_bad == 1) & last_dot & (ends - starts > 1))
    by = np.flatnonzero(quoted)
    starts = starts.copy()
    if len(by):
        coded = _slices(data, starts[by], ends[by]).dictionary_encode()
        found = [_tables()[2].fullmatch(s) for s in coded.dictionary.to_pylist()]
        skip = np.array([len(m[1]) if m else 0 for m in found])
        size = np.array([len(m[2].encode()) if m else 0 for m in found])
        which = coded.indices.to_numpy()
        starts[by] += skip[which]
        ends[by] = starts[by] + size[which]
        keep[by] = size[which] > 0
    simple_dot = last_dot & ~quoted
    ends[simple_dot] -= 1
    starts, ends = starts[keep], ends[keep]
    return _slices(data, starts, ends), np.diff(np.searchsorted(starts, off))


def words(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order, and how many each text has.  A text is ``plain``, lower-cased, and ends with a space; null has none."""
    texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    cuts = np.unique(np.append(np.searchsorted(off, np.arange(off[0], off[-1], PIECE)), len(off) - 1))
    found = [_piece(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]) for lo, hi in zip(np.append(0, cuts[:-1]), cuts) if hi > lo]
    if not found:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    return pa.concat_arrays([f[0] for f in found]), np.concatenate([f[1] for f in found])
