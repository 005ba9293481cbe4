"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one document.  A first pass counts
windows, once a document, in a count-min sketch: every block's partial sketch
is merged cell range by cell range, and sums never fall below the true count.
A second pass takes only windows whose estimate is two or more and groups
them exactly (96-bit digests); no repeated window is lost, as its estimate
cannot be below its count.  Each word is removed that a window covers whose
word sequence also starts in a document with a smaller id.

The sketch grows with the input: it has ``CELLS`` or more cells a word in each
of ``DEPTH`` rows, is spread over the cluster by cell range, and each block gets
back one bit for each of its own cells, so it is nowhere held whole.

Defined cases: a null text has no words; an empty text or one shorter than a
window loses nothing; rows with a null id come back whole, as no id is smaller
than null, and take nothing from others; rows that share an id count as one
document for "smaller", so neither removes words of the other; a passage that
repeats only inside one document stays; a text of any length is taken whole;
other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .blocks import Block, blocks_in, pack
from .storage import durable, unused
from .wordhash import mix, window_hashes, word_bounds, word_hashes

DEPTH = 2
CELLS = 4
OUT = "doc_id long, n_words long, n_removed long, kept binary, text_hash long"


class Windows:
    """Words and windows of a block."""

    def __init__(self, block: Block, size: int):
        self.starts, self.ends = word_bounds(block.buf)
        self.words = word_hashes(block.buf, self.starts, self.ends, 0)
        self.doc = np.searchsorted(block.ends, self.starts, side="right")
        self.keys = window_hashes(self.words, size, 0)
        n = len(self.keys)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)
        self.keys = self.keys[self.at]

    def second(self, block: Block, size: int) -> np.ndarray:
        """The rest of the 96-bit digests."""
        return (window_hashes(word_hashes(block.buf, self.starts, self.ends, 1), size, 1)[self.at] >> np.uint64(32)).astype(np.uint32)


def _cells(keys: np.ndarray, lane: int, shift: int) -> np.ndarray:
    """Sketch cells as 64-bit values whose lowest ``shift`` bits are zero."""
    x = mix(keys + np.uint64(0x9E3779B97F4A7C15 * (lane + 1) % (1 << 64)))
    return x >> np.uint64(shift) << np.uint64(shift)


def _counted(cells: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, each with 1 or 2 for one or more documents."""
    order = np.lexsort((docs, cells)) if len(cells) else np.zeros(0, np.int64)
    c, d = cells[order], docs[order]
    head = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(c)) - 1 if len(c) else head
    return c[head], 1 + (d[head] != d[last]).astype(np.uint8)


def _sketch(size: int, ranges: int, shift: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for number, block in blocks_in(pdf):
                w = Windows(block, size)
                docs = block.ids[w.doc[w.at]]
                rows = []
                for lane in range(DEPTH):
                    cells, counts = _counted(_cells(w.keys, lane, shift), docs)
                    rows += X.deal(number, cells, [counts], ranges, lane, shift)
                if rows:
                    yield pd.DataFrame(rows)

    return run


def _maybe_repeated(w: Windows, said: pd.DataFrame, ranges: int, shift: int) -> np.ndarray:
    """Windows whose least count over the sketch's rows is two or more."""
    out = np.ones(len(w.keys), dtype=bool)
    for lane in range(DEPTH):
        cells, back = np.unique(_cells(w.keys, lane, shift), return_inverse=True)
        mine = said[(said["owner"] >= lane * ranges) & (said["owner"] < (lane + 1) * ranges)]
        bits = X.answers(mine.assign(owner=mine["owner"] - lane * ranges), [cells], ranges, bool)[0]
        out &= bits[back]
    return out


def exact_entries(keys: np.ndarray, second: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 96-bit keys in order with their smallest document, and for each input its place among them."""
    order = np.lexsort((docs, second, keys))
    a, b, d = keys[order], second[order], docs[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], d[new], place


def _exact(size: int, ranges: int, shift: int, exact_ranges: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for number, block in blocks_in(left):
            w = Windows(block, size)
            hot = np.flatnonzero(_maybe_repeated(w, right, ranges, shift))
            a, b, d, _ = exact_entries(w.keys[hot], w.second(block, size)[hot], block.ids[w.doc[w.at[hot]]])
            rows += X.deal(number, a, [b, d], exact_ranges)
        return pd.DataFrame(rows, columns=["owner", "block", "n", "keys", "more"])

    return run


def _cut(size: int, ranges: int, shift: int, exact_ranges: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, block in blocks_in(left):
            w = Windows(block, size)
            hot = np.flatnonzero(_maybe_repeated(w, right[right["pass"] == 1], ranges, shift))
            docs = block.ids[w.doc[w.at[hot]]]
            a, b, d, place = exact_entries(w.keys[hot], w.second(block, size)[hot], docs)
            least = X.answers(right[right["pass"] == 2], [a], exact_ranges, np.int64)[0]
            gone = w.at[hot][least[place] < docs]
            edge = np.zeros(len(w.starts) + 1, dtype=np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + size, -1)
            kept = np.cumsum(edge[:-1]) == 0
            bounds = np.searchsorted(w.doc, np.arange(len(block.ids) + 1))
            for i, doc in enumerate(block.ids.tolist()):
                lo, hi = int(bounds[i]), int(bounds[i + 1])
                mine = kept[lo:hi]
                if mine.all():
                    text = b" ".join(block.text(i).split())
                else:
                    text = b" ".join(x for x, k in zip(block.text(i).split(), mine.tolist(), strict=True) if k)
                rows.append((doc, hi - lo, int((~mine).sum()), text, (xxhash.xxh64_intdigest(block.text(i), 42) ^ 1 << 63) - (1 << 63)))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept", "text_hash"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept`` (UTF-8, words joined by one space).

    ``text_hash`` is Spark's ``xxhash64`` of the text that was read (of '' for null).
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    own = F.col(f"`{id_col}`").cast("long")
    nameless = df.where(own.isNull()).select(own.alias("doc_id"), F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(words, " ").cast("binary").alias("kept"), F.xxhash64(text).alias("text_hash"))
    blocks, _ = pack(df, id_col, text_col)
    size = blocks.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("n")).first()["n"]
    entries = max(1, size // 6)
    ranges = X.ranges_for(blocks, entries, 0, size)
    shift = 64 - max(1, (entries * CELLS).bit_length())
    blobs = blocks.mapInPandas(_sketch(window, ranges.coarse, shift), X.BLOB)
    # the bits that came back are small and used by both later passes
    merged, _ = durable(X.resolve(blobs, ranges, (lambda keys, more: X.seen_twice(keys, more[0]), [np.uint8]), kinds=(bool,), shift=shift), "estimates")
    exact_ranges = X.ranges_for(blocks, entries // 2, 0, size)
    second = blocks.groupBy("block").cogroup(merged.groupBy("block")).applyInPandas(_exact(window, ranges.coarse, shift, exact_ranges.coarse), X.BLOB)
    least = X.resolve(second, exact_ranges, (lambda keys, more: X.least_doc(keys, *more), [np.uint32, np.int64]))
    said = merged.withColumn("pass", F.lit(1)).union(least.withColumn("pass", F.lit(2)))
    return blocks.groupBy("block").cogroup(said.groupBy("block")).applyInPandas(_cut(window, ranges.coarse, shift, exact_ranges.coarse), OUT).union(nameless)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``df`` with its repeated passages cut out of ``text_col``.

    Texts that lose nothing stay as they are, white space included; rows that
    lose all their words go; rows with a null id stay as they are.
    """
    own, seen, kept, gone = unused(df.columns, "id", "hash", "kept", "gone")
    cut = remove_repeats(df, id_col, text_col, window).where("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias(own), F.col("text_hash").alias(seen), F.decode("kept", "UTF-8").alias(kept), (F.col("n_removed") == F.col("n_words")).alias(gone)).dropDuplicates([own, seen])
    text = F.col(f"`{text_col}`")
    met = df.join(cut, (F.col(f"`{id_col}`").cast("long") == F.col(own)) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col(seen)), "left").where(f"{gone} is null or not {gone}")
    return met.select(*(F.coalesce(kept, text).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))
