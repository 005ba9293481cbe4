"""Pre-tokens of the byte-level tokenizers, and distinct pre-tokens of a block of documents."""

from __future__ import annotations

import base64

import numpy as np
import regex

#: The pattern that byte-level BPE vocabularies split text with before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter(pattern: str = PATTERN):
    return regex.compile(pattern).findall


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ragged rows ``picks`` of ``flat``; returns the values and each pick's size."""
    size = sizes[picks]
    if not len(picks):
        return flat[:0], size
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(starts[picks] - (ends - size), size)
    return flat[at], size


# --- the same split for many texts at once ------------------------------------
#
# Character classes decide where pre-tokens start, so a batch of texts is split
# by a few vector operations over its code points.

SPACE, WHITE, LETTER, NUMBER, OTHER, END = range(6)
#: Marks the end of a text; no code point.
STOP = 0x110000
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point, as the pattern's own properties give it."""
    if not _classes:
        table = np.full(STOP + 1, OTHER, dtype=np.uint8)
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(STOP))
        for kind, name in ((WHITE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(name, every):
                table[m.start() : m.end()] = kind
        table[0xD800:0xE000] = OTHER
        table[0x20] = SPACE
        table[STOP] = END
        _classes.append(table)
    return _classes[0]


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a STOP after each, and where each begins."""
    parts = [np.frombuffer((t or "").encode("utf-32-le"), dtype=np.uint32) for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, STOP, dtype=np.uint32)
    for p, e in zip(parts, ends.tolist(), strict=True):
        out[e - 1 - len(p) : e - 1] = p
    return out, ends - size


def split_points(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in ``codes``."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes()[codes]
    white = kind <= WHITE
    before = np.empty_like(kind)
    before[0], before[1:] = END, kind[:-1]
    after_ink = np.zeros(n, dtype=bool)  # white, with ink behind it
    after_ink[:-1] = white[:-1] & ~white[1:] & (kind[1:] != END)
    new_white = white & ~((before <= WHITE))
    new_run = ~white & (kind != before) & (before != SPACE)
    start = new_white | after_ink | new_run
    # 's 't 're 've 'm 'll 'd where a match begins at the apostrophe
    marks = np.flatnonzero(start & (codes == 0x27))
    if len(marks):
        one = codes[np.minimum(marks + 1, n - 1)]
        two = codes[np.minimum(marks + 2, n - 1)]
        single = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        double = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for size, fits in ((1, single), (2, double)):
            at = marks[fits] + size + 1
            start[marks[fits] + 1] = False
            start[at[kind[at] == LETTER]] = True
    start |= kind == END
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], n)
    ink = kind[begins] != END
    return begins[ink], ends[ink]


class WordTable:
    """Rows of words by two hashes: open addressing, all operations on vectors."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.first = np.zeros(1 << bits, dtype=np.uint64)
        self.second = np.zeros(1 << bits, dtype=np.uint64)
        self.row = np.full(1 << bits, -1, dtype=np.int64)
        self.count = 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of each word, or -1."""
        slot = (a >> np.uint64(64 - self.bits)).astype(np.int64)
        row = self.row[slot]
        same = (self.first[slot] == a) & (self.second[slot] == b)
        out = np.where(same, row, -1)
        left = np.flatnonzero(~same & (row >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            s = slot[left]
            row = self.row[s]
            same = (self.first[s] == a[left]) & (self.second[s] == b[left])
            out[left] = np.where(same, row, -1)
            left = left[~same & (row >= 0)]
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Give distinct new words the next rows."""
        rows = np.arange(self.count, self.count + len(a))
        self.count += len(a)
        slot = (a >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(a))
        while len(left):
            free = left[self.row[slot[left]] < 0]
            _, pick = np.unique(slot[free], return_index=True)
            put = free[pick]
            self.first[slot[put]], self.second[slot[put]], self.row[slot[put]] = a[put], b[put], rows[put]
            done = np.zeros(len(a), dtype=bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return rows


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of code points."""
    return tuple(_span_hash(codes, starts, ends, lane) for lane in (0, 1))


def _span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    from .wordhash import _BASES, _power, mix

    out = np.empty(len(starts), dtype=np.uint64)
    step, at = 1 << 18, 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, first + step, side="right")))
        last = int(ends[to - 1])
        up, down = _power(_BASES[lane], max(step, last - first) + 1)
        total = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum((codes[first:last] + np.uint64(1)) * up[: last - first], out=total[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        at = to
    return out
