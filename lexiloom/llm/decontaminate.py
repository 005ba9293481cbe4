"""Benchmark decontamination with SimHash windows and exact verification.

Words are runs of letters, digits and non-ASCII characters, lower-cased;
shingles are five words.  Every window of a document that is as long as a
benchmark item (the whole document if it is shorter) can match it.  A window
gets a 512-bit SimHash of its shingles, and a multi-index over the items of
its size finds all fingerprints within ``RADIUS`` bits: they are cut in
``BLOCKS`` blocks, and whatever is within the radius agrees in some block up
to ``RADIUS // BLOCKS`` bits, so those that agree in none are left out (of
unrelated items all but a few in a thousand) and the others are checked in
full.  Only what the index finds is a candidate; candidates are verified by
the exact weighted Jaccard similarity of their shingle multisets, which must
be ``THRESHOLD`` or more.

Two windows similar by 0.8 differ in about 15 % of the bits (19 % at worst,
for a document of eight words against an item of nine); the radius of 28 % is
five deviations beyond the worst case and eight beyond the usual one.

A filter of windows stands in front: a window with fewer shingles known to
any item than similarity 0.8 needs is never fingerprinted.  The bound is exact,
so the filter loses nothing, and it names no candidates.

The items are sent to every worker while they are under ``MAX_ITEM_BYTES``;
larger benchmarks are taken in hash blocks of that size, one pass each.

Defined cases: null or blank texts and items match nothing; items of fewer
than five words are one shingle and match only windows of the same words; of
an item's best windows in a document the first is given; the ids may be null or
repeat, each row being judged alone; a text of any length is taken whole;
other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import once_a_worker, slices
from .wordhash import mix, window_hashes, word_bounds, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BITS = 512
RADIUS = 144
#: One 64-bit number each.
BLOCKS = BITS // 64
MAX_ITEM_BYTES = 32 << 20
OUT = "doc_id long, item_id long, similarity double, start_word long, n_words long"

#: ASCII that is neither letter nor digit counts as white space.
_FOLD = bytes(i if chr(i).isalnum() or i > 127 else 32 for i in range(256))
#: Shingles whose bits are summed together, and pairs of fingerprints compared together.
_RUN, _PAIRS = 2048, 1 << 18


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the text each belongs to."""
    folded = [(t or "").lower().encode().translate(_FOLD) + b"\n" for t in texts]
    buf = np.frombuffer(b"".join(folded), np.uint8)
    starts, ends = word_bounds(buf)
    edges = np.cumsum(np.fromiter(map(len, folded), np.int64, len(folded)))
    return word_hashes(buf, starts, ends, 0), np.searchsorted(edges, starts, side="right")


def window_prints(shingles: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """SimHashes (rows of ``BLOCKS`` numbers) of the windows of ``span`` shingles at ``starts`` (ascending); a bit is set if it is in over half of them."""
    out = np.empty((len(starts), BLOCKS), dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        # windows that overlap or adjoin share one table of sums
        apart = np.flatnonzero(np.diff(starts[at:]) > span)
        to = min(at + int(apart[0]) + 1 if len(apart) else len(starts), at + int(np.searchsorted(starts[at:], first + _RUN)))
        own = shingles[first : int(starts[to - 1]) + span]
        lanes = np.stack([mix(own + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(BLOCKS)], axis=1)
        sums = np.zeros((len(own) + 1, BITS), dtype=np.int32)
        np.cumsum(np.unpackbits(lanes.view(np.uint8), axis=1), axis=0, out=sums[1:])
        s = starts[at:to] - first
        out[at:to] = np.packbits((sums[s + span] - sums[s]) * 2 > span, axis=1).view(np.uint64)
        at = to
    return out


class MultiIndex:
    """Fingerprints by their blocks; ``near`` finds all within the radius (and no others)."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.blocks = np.ascontiguousarray(prints.T)
        self.prints, self.radius, self.budget = prints, radius, radius // BLOCKS

    def passing(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) pairs that agree in some block within its budget."""
        met = np.zeros((len(prints), len(self.prints)), dtype=bool)
        for own, theirs in zip(prints.T, self.blocks, strict=True):
            met |= np.bitwise_count(own[:, None] ^ theirs[None, :]) <= self.budget
        return np.nonzero(met)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) pairs within the radius."""
        found = []
        step = max(1, _PAIRS // max(1, len(self.prints)))
        for at in range(0, len(prints), step):
            q, i = self.passing(prints[at : at + step])
            close = np.bitwise_count(prints[at + q] ^ self.prints[i]).sum(axis=1) <= self.radius
            found.append((q[close] + at, i[close]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def least_common(m: int, span: int) -> int:
    """Common shingles that ``m`` and ``span`` shingles need for the threshold: similarity >= t needs t (m + span) / (1 + t) or more."""
    return int(np.ceil(THRESHOLD * (m + span) / (1 + THRESHOLD) - 1e-9))


class Benchmark:
    """Items prepared for matching: by words in a shingle and number of shingles, their multisets and a multi-index."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        words, of = _words([t for _, t in items])
        bounds = np.searchsorted(of, np.arange(len(items) + 1))
        self.ids = [i for i, _ in items]
        classes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for n in range(len(items)):
            own = words[bounds[n] : bounds[n + 1]]
            if len(own):
                width = min(SHINGLE, len(own))
                shingles = window_hashes(own, width)
                classes[width, len(shingles)].append((n, shingles))
        #: words in a shingle -> shingles in an item, ascending -> (items, their multisets, multi-index)
        self.sizes: dict[int, dict[int, tuple]] = defaultdict(dict)
        known = defaultdict(list)
        for (width, m), members in sorted(classes.items(), key=lambda x: x[0]):
            bags = [np.unique(x, return_counts=True) for _, x in members]
            prints = np.concatenate([window_prints(x, np.zeros(1, np.int64), m) for _, x in members])
            self.sizes[width][m] = [n for n, _ in members], bags, MultiIndex(prints)
            known[width] += [keys for keys, _ in bags]
        self.known = {width: np.unique(np.concatenate(x)) for width, x in known.items()}
        self.bitmaps = {}
        for width, keys in self.known.items():
            self.bitmaps[width] = np.zeros(1 << 22, dtype=bool)
            self.bitmaps[width][keys >> np.uint64(42)] = True

    def hits(self, width: int, grams: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        known = self.known[width]
        at = np.flatnonzero(self.bitmaps[width][grams >> np.uint64(42)])
        spot = np.searchsorted(known, grams[at])
        return at[known[np.minimum(spot, len(known) - 1)] == grams[at]]

    def match(self, width: int, grams: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of a document's shingles; the best window of each item."""
        total = np.zeros(len(grams) + 1, dtype=np.int64)
        total[hits + 1] = 1
        np.cumsum(total, out=total)
        for m, (items, bags, index) in self.sizes[width].items():
            span = min(m, len(grams))
            least = least_common(m, span)
            if len(hits) < least:
                break  # larger items need more
            starts = np.flatnonzero(total[span:] - total[: len(total) - span] >= least)
            q, i = index.near(window_prints(grams, starts, span))
            best: dict[int, tuple[float, int]] = {}
            for s, k in zip(starts[q].tolist(), i.tolist(), strict=True):
                similarity = _weighted_jaccard(grams[s : s + span], *bags[k], m)
                if similarity >= THRESHOLD and similarity > best.get(k, (0.0,))[0]:
                    best[k] = similarity, s
            yield from ((items[k], similarity, s, span + width - 1) for k, (similarity, s) in best.items())


def _weighted_jaccard(window: np.ndarray, keys: np.ndarray, counts: np.ndarray, m: int) -> float:
    """Weighted Jaccard similarity of a window's shingles and an item's ``m`` (distinct ones with their counts)."""
    spot = np.minimum(np.searchsorted(keys, window), len(keys) - 1)
    own = np.bincount(spot[keys[spot] == window], minlength=len(keys))
    both = int(np.minimum(own, counts).sum())
    return both / (len(window) + m - both)


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, in blocks of a bounded size."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // MAX_ITEM_BYTES))
    for k in range(parts):
        part = benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _found(bench: Benchmark, texts: list[str | None]) -> dict[tuple[int, int], list]:
    """(text, item) -> (similarity, first word, words) of the best window."""
    words, of = _words(texts)
    found = {}
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for width in bench.sizes:
        grams = window_hashes(words, width)
        hits = bench.hits(width, grams)
        hits = hits[of[hits] == of[hits + width - 1]]
        for d in np.unique(of[hits]).tolist():
            lo, hi = int(bounds[d]), int(bounds[d + 1]) - width + 1
            mine = hits[np.searchsorted(hits, lo) : np.searchsorted(hits, hi)] - lo
            found |= {(d, i): rest for i, *rest in bench.match(width, grams[lo:hi], mine)}
    return found


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words``: for each document and item that match, the best window."""
    spark = docs.sparkSession
    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    out = None
    for block in _item_blocks(_items(benchmark, item_col, item_text_col)):
        shared = spark.sparkContext.broadcast(block)  # at most MAX_ITEM_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = once_a_worker(shared, Benchmark)
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], bench.ids[i], *rest) for (d, i), rest in _found(bench, batch.column(1).to_pylist()).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        found = two.mapInArrow(run, OUT)
        out = found if out is None else out.union(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns, whatever their names; no shuffle.

    Rows whose text is null or blank stay; so do all rows where there are no items.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for block in _item_blocks(_items(benchmark, item_col, item_text_col)):
        shared = spark.sparkContext.broadcast(block)  # at most MAX_ITEM_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = once_a_worker(shared, Benchmark)
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[d for d, _ in _found(bench, batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
