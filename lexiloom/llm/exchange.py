"""All-to-all exchange of hashed keys between blocks and key ranges.

Each block sends its distinct keys once, sorted and delta-packed, one blob for
each key range; the owner of a range sorts what it got, compares neighbours
and sends every block its answers in the order of that block's keys.  A key
that occurs a million times in a block costs one entry, so hot keys never pile
up; the keys are hashes, so ranges are even.  A range is as large as
``RANGE_ENTRIES`` says, and there are at least as many as shuffle partitions.

With ever more ranges a block's keys would fall apart into a blob each.  So
blocks send to ``FAN`` coarse ranges at most, and where that is not fine
enough, a second level parts them: the blobs of a team of blocks for a coarse
range are merged and cut into fine ranges, and the answers come back the same
way.  A blob holds some ``BLOB_KEYS`` keys then, whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, expand, squeeze
from .storage import durable, shuffle_width

#: Entries that the owner of a range holds at once.
RANGE_ENTRIES = 1_000_000
#: Most blobs that a block sends, and the keys of a blob between the levels.
FAN, BLOB_KEYS = 4096, 64
BLOB = "owner long, block long, n int, keys binary, more binary"
ANSWER = "block long, owner long, answer binary"


@dataclass(frozen=True)
class Ranges:
    """``coarse`` ranges that blocks send to, each of ``sub`` fine ones, and ``teams`` of blocks between them."""

    coarse: int
    sub: int = 1
    teams: int = 1


def ranges_for(df: DataFrame, entries: int, most: int = 0, raw_bytes: int = 0) -> Ranges:
    """How many key ranges suit so many entries, ``most`` of them (``RANGE_ENTRIES`` if 0) in each, of blocks with so many bytes of text."""
    wanted = max(shuffle_width(df.sparkSession), -(-int(entries) // (most or RANGE_ENTRIES)))
    if wanted <= FAN:
        return Ranges(wanted)
    sub, blocks = -(-wanted // FAN), max(1, raw_bytes // BLOCK_BYTES)
    # blocks whose keys for a coarse range make a blob of BLOB_KEYS for each of its fine ones
    team = max(1, sub * BLOB_KEYS * FAN * blocks // max(1, int(entries)))
    return Ranges(FAN, sub, max(1, -(-blocks // team)))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as zstd-packed byte planes of their differences."""
    step = np.diff(values, prepend=np.uint64(0))
    used = max(1, -(-int(step.max()).bit_length() // 8)) if len(step) else 1
    return bytes([used]) + squeeze(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :used].T).tobytes())


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    used = data[0]
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :used] = np.frombuffer(expand(data[1:]), np.uint8).reshape(used, n).T
    return np.cumsum(wide.reshape(-1).view(np.uint64))


def cut_points(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where sorted keys pass from one range to the next; ranges split 2^64 evenly."""
    edges = np.array([(i << 64) // ranges for i in range(ranges)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def deal(block: int, keys: np.ndarray, more: list[np.ndarray], ranges: int, lane: int = 0, shift: int = 0) -> Iterator[dict]:
    """Rows of :data:`BLOB` for a block's sorted keys; ``more`` are columns beside them; the lowest ``shift`` bits are zero and not sent."""
    cuts = cut_points(keys, ranges)
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[i]), int(cuts[i + 1])
        yield {"owner": lane * ranges + i, "block": block, "n": b - a, "keys": pack_sorted(keys[a:b] >> np.uint64(shift)), "more": squeeze(b"".join(x[a:b].tobytes() for x in more))}


Lane = tuple[Callable[[np.ndarray, list[np.ndarray]], np.ndarray], list]


def _unpacked(pdf: pd.DataFrame, dtypes: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and columns of all blobs, one after the other."""
    keys, columns = [], [[] for _ in dtypes]
    for n, packed, more in zip(pdf["n"], pdf["keys"], pdf["more"], strict=True):
        keys.append(unpack_sorted(bytes(packed), n))
        raw, at = expand(more), 0
        for c, kind in zip(columns, dtypes, strict=True):
            size = n * np.dtype(kind).itemsize
            c.append(np.frombuffer(raw, kind, n, at))
            at += size
    return np.concatenate(keys), [np.concatenate(c) for c in columns]


def _packed_answers(pdf: pd.DataFrame, said: np.ndarray) -> pd.DataFrame:
    """Answers in the order of the blobs' entries, packed for each blob."""
    ends = np.cumsum(pdf["n"].to_numpy())
    parts = [said[e - n : e] for e, n in zip(ends, pdf["n"], strict=True)]
    packed = [squeeze((np.packbits(x) if x.dtype == bool else x).tobytes()) for x in parts]
    return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "answer": packed})


def _fine_cuts(keys: np.ndarray, coarse: int, ranges: Ranges, shift: int) -> np.ndarray:
    """Where sorted keys of a coarse range pass from one fine range to the next."""
    edges = np.array([((coarse * ranges.sub + j) << 64) // (ranges.coarse * ranges.sub) for j in range(ranges.sub)], dtype=np.uint64)
    return np.append(np.searchsorted(keys << np.uint64(shift), edges), len(keys))


def resolve(blobs: DataFrame, ranges: Ranges, *lanes: Lane, kinds: tuple = (np.int64,), shift: int = 0) -> DataFrame:
    """Answers of every range.

    A lane's ``judge(keys, columns)`` gives an answer of its kind for each entry
    of a range; further lanes are like the last one given.  ``shift``: bits
    that the keys were sent without.
    """
    lane = lambda owner: min(int(owner) // ranges.coarse, len(lanes) - 1)

    def judged(pdf: pd.DataFrame) -> pd.DataFrame:
        judge, dtypes = lanes[lane(pdf["owner"].iloc[0] // ranges.sub)]
        return _packed_answers(pdf, judge(*_unpacked(pdf, dtypes)))

    if ranges.sub == 1:
        return blobs.groupBy("owner").applyInPandas(judged, ANSWER)

    def ordered(pdf: pd.DataFrame) -> tuple[int, pd.DataFrame, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("block", kind="stable")
        owner = int(pdf["owner"].iloc[0])
        keys, columns = _unpacked(pdf, lanes[lane(owner)][1])
        order = np.argsort(keys, kind="stable")
        return owner, pdf, keys[order], columns, order, _fine_cuts(keys[order], owner % ranges.coarse, ranges, shift)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        owner, pdf, keys, columns, order, cuts = ordered(pdf)
        rows = []
        for j in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = int(cuts[j]), int(cuts[j + 1])
            rows.append({"owner": owner * ranges.sub + j, "block": pdf["meeting"].iloc[0], "n": b - a, "keys": pack_sorted(keys[a:b]), "more": squeeze(b"".join(c[order[a:b]].tobytes() for c in columns))})
        return pd.DataFrame(rows)

    def parted(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"block": [], "owner": [], "answer": []})
        owner, pdf, keys, _, order, cuts = ordered(left)
        got = dict(zip(right["owner"], right["answer"], strict=True))
        kind = kinds[min(lane(owner), len(kinds) - 1)]
        said = np.empty(len(keys), dtype=kind)
        for j in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = int(cuts[j]), int(cuts[j + 1])
            raw = expand(got[owner * ranges.sub + j])
            said[order[a:b]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool) if kind is bool else np.frombuffer(raw, kind)
        return _packed_answers(pdf, said)

    meeting = F.col("owner") * ranges.teams + F.pmod(F.xxhash64("block"), F.lit(ranges.teams))
    sent, _ = durable(blobs.withColumn("meeting", meeting), "blobs")
    fine = sent.groupBy("meeting").applyInPandas(merged, BLOB).groupBy("owner").applyInPandas(judged, ANSWER)
    return sent.groupBy("meeting").cogroup(fine.groupBy("block")).applyInPandas(parted, ANSWER)


def answers(pdf: pd.DataFrame, keys: list[np.ndarray], ranges: int, kind) -> list[np.ndarray]:
    """For each lane's sorted keys of one block, the answers in that order."""
    out = []
    got = dict(zip(pdf["owner"], pdf["answer"], strict=True))
    for lane, own in enumerate(keys):
        cuts = cut_points(own, ranges)
        parts = [np.zeros(0, dtype=kind)]
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            n, raw = int(cuts[i + 1] - cuts[i]), expand(got[lane * ranges + i])
            parts.append(np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) if kind is bool else np.frombuffer(raw, kind))
        out.append(np.concatenate(parts))
    return out


def seen_twice(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every entry: do the counts of its key sum to two or more?"""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order].astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
    out = np.empty(len(keys), dtype=bool)
    out[order] = np.repeat(total >= 2, np.diff(np.append(head, len(ranked))))
    return out


def least_doc(keys: np.ndarray, second: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every entry: the smallest document with the same key and second key."""
    order = np.lexsort((second, keys))
    a, b = keys[order], second[order]
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(doc[order], head) if len(head) else np.zeros(0, np.int64)
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.repeat(least, np.diff(np.append(head, len(a))))
    return out
