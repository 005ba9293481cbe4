"""Vectorised hashes of words and word windows over one buffer of UTF-8 text.

A word is a run of bytes other than space and 0x09-0x0D.  Its 64-bit hash is a
polynomial over its bytes modulo 2^64, finished with an avalanche step; a
window's hash is a polynomial over its words' hashes.  Two independent bases
give 128-bit keys.  Prefix sums make both linear in the text.
"""

from __future__ import annotations

import numpy as np
import xxhash

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_CHUNK = 1 << 18
#: Words longer than this are hashed one by one with XXH3 (polynomials modulo 2^64 are weak on long structured strings).
_LONG = 256
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEPS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit avalanche (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, cached in doubling sizes."""
    top = 1 << max(10, (size - 1).bit_length())
    for (b, n), found in _powers.items():
        if b == base and n >= size:
            return found
    with np.errstate(over="ignore"):
        up = np.full(top, base, dtype=np.uint64)
        up[0] = 1
        down = np.full(top, pow(base, -1, 1 << 64), dtype=np.uint64)
        down[0] = 1
        found = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    for key in [k for k in _powers if k[0] == base]:
        del _powers[key]
    _powers[base, top] = found
    return found


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = np.zeros(len(buf) + 2, dtype=np.int8)
    ink[1:-1] = ~WHITE[buf]
    turn = np.diff(ink)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """The 64-bit hash of each word."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    long = (ends - starts) > _LONG
    base, tag = _BASES[lane], np.uint64(_STEPS[lane])
    up, down = _power(base, _CHUNK + _LONG + 1)
    at, n = 0, len(starts)
    while at < n:
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, first + _CHUNK)))
        piece = buf[first : min(first + _CHUNK + _LONG, len(buf))].astype(np.uint64)
        piece += np.uint64(1)
        piece *= up[: len(piece)]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece, out=total[1:])
        s = starts[at:to] - first
        e = np.minimum(ends[at:to] - first, len(piece))
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * tag)
        at = to
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), lane + 1)
    return out


def window_hashes(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """The 64-bit hash of every run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(_STEPS[lane] | 1, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n] + np.uint64(size))


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """``best`` over every run of ``width`` values, in a logarithmic number of passes."""
    span, out = 1, values
    while span < width:
        hop = min(span, width - span)
        if len(out) <= hop:
            return out[:0]
        out = best(out[:-hop], out[hop:])
        span += hop
    return out
