"""SimHash near-dedup with Pigeonring candidate filtering.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``shingle`` words (repeats included) joined by a space, XXH64 with seed 42; a
bit is set if it is set in over half of the hashes.

Pairs of fingerprints that differ in at most ``radius`` bits are found on the
ring of ``radius + 1`` segments.  The pigeonring principle says that some
start has a chain of consecutive segments whose cumulative differences stay
within the proportional budgets ``length * radius / segments``; all are
whole numbers here once rounded down: none in the first segment, one by the
second, ``radius`` over all.  The first two links of the chain make the join
key: the start segment as it is, the second with at most one bit changed (the
change is made on one side only).  What comes out of the join is checked
against the rest of the chain, then by the full Hamming distance.

Documents are first grouped by fingerprint, so copies are one class and are
never paired; links are between classes, and components come from a
distributed star contraction.

Defined cases: a null or blank text has fingerprint zero and links like any
other; fewer words than a shingle make one shingle of them all; rows with a
null id get a fingerprint but no component of their own (the class has the
smallest id that is not null, or null); rows that share an id stay as they
are; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import key_bitmap, with_hits
from .graph import components
from .storage import drop_path, durable, shuffle_width, slices, unused

SEED = 42
RADIUS = 2
#: Documents of a verified group that the first round decides together, in order of ids; how many times as many each next round does, and the most.
HEAD, GROWTH, MOST_HEAD = 256, 4, 4096
#: Seeds of the word fingerprints that the filter groups by.
WORD_SEEDS = (SEED, SEED + 1, SEED + 2)
#: Their radius: wider than that of whole texts, as what they group is verified.
WORD_RADIUS = 3


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text."""
    raw = text.encode() if isinstance(text, str) else text
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(x, shingle) for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(offset, width) of the ``radius + 1`` ring segments."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(fp, offset: int, width: int):
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))


def _chain_key(start: int, first, second):
    return lambda flip: F.struct(F.lit(start).alias("start"), first.bitwiseOR(second.bitwiseXOR(flip)).alias("key"))


def chain_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``, a < b: all pairs of the distinct fingerprints in ``fp`` within ``radius`` bits (some may repeat)."""
    ring = segments(radius)
    n = len(ring)
    fp = F.col("fp")
    if n == 1:
        return fps.select(fp.alias("a"), fp.alias("b")).where("false")
    second_budget = 2 * radius // n
    # each fingerprint becomes many rows, so they are spread before that
    fps = fps.repartition(shuffle_width(fps.sparkSession))
    sides = []
    for probe in (False, True):
        keys = []
        for i in range(n):
            first, second = _part(fp, *ring[i]), _part(fp, *ring[(i + 1) % n])
            width = ring[(i + 1) % n][1]
            flips = [0, *(1 << b for b in range(width))] if probe and second_budget else [0]
            keys.append(F.transform(F.array(*(F.lit(x).cast("long") for x in flips)), _chain_key(i, F.shiftleft(first, width), second)))
        sides.append(fps.select(fp, F.explode(F.flatten(F.array(*keys))).alias("k")).select("k.start", "k.key", "fp"))
    left, right = sides[0].withColumnRenamed("fp", "a"), sides[1].withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # The rest of the chain from the start segment: cumulative differences within the proportional budgets.
    within = F.lit(False)
    for i in range(n):
        total, holds = F.lit(0), F.col("start") == i
        for length in range(1, n):
            total = total + F.bit_count(_part(differ, *ring[(i + length - 1) % n]))
            holds = holds & (total <= length * radius // n)
        within = within | holds
    # Spark takes the exploded rows to be as large as the fingerprints, and would broadcast them from the driver
    met = left.hint("merge").join(right.hint("merge"), ["start", "key"]).where("a <> b").where(within).where(F.bit_count(differ) <= radius)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id`` (smallest id reachable over links)."""
    prints, _ = durable(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    return prints.join(_grouped(prints, "fp", radius), "fp")


def word_fingerprint(text: str | bytes | None, seed: int = SEED) -> int:
    """64-bit SimHash of a text's distinct words (lower-cased as in :func:`fingerprint`): edits of a few words move it little."""
    return word_fingerprints(text, (seed,))[0]


def word_fingerprints(text: str | bytes | None, seeds: tuple[int, ...]) -> list[int]:
    """One for each seed; the hashes under different seeds are independent."""
    raw = text.encode() if isinstance(text, str) else text
    words = set(raw.lower().split()) if raw else ()
    if not words:
        return [0] * len(seeds)
    digest, out = xxhash.xxh64_intdigest, []
    for seed in seeds:
        hashes = np.array([digest(w, seed) for w in words], dtype=">u8")
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big"))
    return out


def shingle_similarity(a: str | bytes | None, b: str | bytes | None, size: int = 5) -> float:
    """Jaccard similarity of the sets of ``size``-word shingles (all words where there are fewer); 1 for two texts without words."""
    return _jaccard(_shingles(a, size), _shingles(b, size))


def _shingles(text: str | bytes | None, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    raw = text.encode() if isinstance(text, str) else text
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))), np.uint64))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _grouped(prints: DataFrame, fp: str, radius: int) -> DataFrame:
    """``fp, component_id`` of the fingerprints of ``prints`` (``doc_id`` and the column ``fp``)."""
    classes = prints.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("first"))
    named = components(chain_links(classes.select("fp"), radius).distinct().toDF("u", "v"))
    # components() names a component by a fingerprint; its smallest document id names it for the caller
    own = classes.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    return own.join(least, "component").select("fp", "component_id")


class _Kept:
    """Shingle sets that stay, found again by anything at least ``similar`` to one of them."""

    def __init__(self, similar: float):
        self.similar, self.sets, self.index = similar, [], {}

    def _prefix(self, own: np.ndarray) -> list:
        # in one order of all shingles, two sets this similar share one of their first n - ceil(similar * n) + 1
        return own[: len(own) - math.ceil(self.similar * len(own) - 1e-9) + 1].tolist() or [-1]

    def add(self, own: np.ndarray) -> None:
        self.sets.append(own)
        for x in self._prefix(own):
            self.index.setdefault(x, []).append(len(self.sets) - 1)

    def like(self, own: np.ndarray) -> bool:
        met = {k for x in self._prefix(own) for k in self.index.get(x, ())}
        near = (self.sets[k] for k in sorted(met) if self._sizes_fit(len(own), len(self.sets[k])))
        return any(_jaccard(own, other) >= self.similar for other in near)

    def _sizes_fit(self, a: int, b: int) -> bool:
        return min(a, b) >= self.similar * max(a, b) - 1e-9


def _settle(texts: DataFrame, members: DataFrame, similar: float, size: int, first: int) -> DataFrame:
    """One round over groups (``doc_id, centre``): ``doc_id, centre, gone`` of those with two members or more.

    The ``first`` smallest ids of each group are decided in order of ids and
    the others are held against those of them that stay, in parts of about
    as many.  ``gone`` is null for what is still to be decided among the
    others.  An id with several texts goes if one of them is like another
    document, and its least text is what others are held against.
    """
    sizes = members.groupBy("centre").agg(F.count("*").alias("n")).where("n > 1").select("centre", F.ceil(F.col("n") / first).cast("int").alias("parts"))
    rank = F.row_number().over(Window.partitionBy("centre").orderBy("doc_id"))
    cuts = members.withColumn("rank", rank).where(F.col("rank") <= first).groupBy("centre").agg(F.max("doc_id").alias("cut"))
    dealt = members.join(sizes, "centre").join(cuts, "centre").withColumn("head", F.col("doc_id") <= F.col("cut"))
    parts = F.when(F.col("head"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))
    dealt = dealt.select("doc_id", "centre", "head", F.explode(parts).alias("part"))
    # near copies take little room in a file, by which Spark would broadcast their texts from the driver
    tiles = texts.hint("merge").join(dealt, "doc_id").select("centre", "part", "doc_id", "head", "text").repartition("centre", "part").sortWithinPartitions("centre", "part", "doc_id", F.col("text").asc_nulls_last())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in slices(batches) for row in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4).cast(pa.large_binary()).to_pylist(), strict=True))
        for (centre, part), tile in groupby(rows, key=itemgetter(0, 1)):
            kept, out = _Kept(similar), []
            for doc, own in groupby(tile, key=itemgetter(2)):
                head, sets = zip(*((row[3], _shingles(row[4], size)) for row in own), strict=True)
                gone = any(map(kept.like, sets)) or None
                if head[0]:
                    gone = bool(gone)
                    if not gone:
                        kept.add(sets[0])
                if not head[0] or part == 0:
                    out.append((doc, gone))
            ids, gones = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([centre] * len(ids), pa.int64()), pa.array(gones, pa.bool_())], names=["doc_id", "centre", "gone"])

    return tiles.mapInArrow(decide, "doc_id long, centre long, gone boolean")


def _gone(two: DataFrame, left: DataFrame, fp: str, radius: int, similar: float, size: int) -> DataFrame:
    """``doc_id`` of those of ``left`` that go, by groups over one of their fingerprints.

    Texts of group members are taken out once, behind a bitmap of their ids, and
    rounds read those alone.  A round decides ever more ids of each group, so
    groups of some five thousand take three rounds, and each further
    ``MOST_HEAD`` that are like none before them take one more.
    """
    own = left.select("doc_id", F.col(fp).alias("print"))
    met = own.join(_grouped(own, "print", radius).withColumnRenamed("fp", "print"), "print").select("doc_id", F.col("component_id").alias("centre"))
    several = met.groupBy("centre").agg(F.max("doc_id").alias("last")).where("last > centre").select("centre")
    open_, _ = durable(met.join(several, "centre").select("doc_id", "centre").distinct(), "wanted")
    gone, first = open_.where("false").select("doc_id"), HEAD
    if open_.isEmpty():
        return gone
    wanted = open_.select("doc_id").distinct()
    bitmap, bits = key_bitmap(wanted.select(F.xxhash64("doc_id").alias("k")))
    texts, held = durable(with_hits(two.where("doc_id is not null"), F.xxhash64("doc_id"), bitmap, bits).where("hit").select("doc_id", "text").join(wanted, "doc_id", "left_semi"), "members")
    while not open_.isEmpty():
        settled, _ = durable(_settle(texts, open_, similar, size, first), "settled")
        gone = gone.union(settled.where("gone").select("doc_id"))
        open_, first = settled.where("gone is null").select("doc_id", "centre"), max(first, min(first * GROWTH, MOST_HEAD))
    out, _ = durable(gone.distinct(), "gone")
    drop_path(two.sparkSession, held)
    return out


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, similar: float = 0.8, similar_shingle: int = 5, seeds: tuple[int, ...] = WORD_SEEDS, word_radius: int = WORD_RADIUS) -> DataFrame:
    """The rows of ``df`` that stay: one document of each group of near duplicates.

    First, of each component of :func:`near_duplicates` the smallest id stays.
    Among the rest, groups are formed the same way over fingerprints of the
    distinct words, which come closer for lightly edited texts, once for each
    of ``seeds``; there, in order of ids, a document goes if its similarity to
    a smaller id of its group that stays, by ``similar_shingle``-word shingles,
    is at least ``similar`` (above zero).

    Rows that share the smallest id stay together; rows with a null id stay;
    null and blank texts are near each other; an empty table stays empty; all
    columns are passed on, whatever their names.
    """
    text = F.col(f"`{text_col}`").cast("string")
    two = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    names = [f"word_{k}" for k in range(len(seeds))]

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            fps = [[fingerprint(x, shingle) for x in texts], *zip(*(word_fingerprints(x, seeds) for x in texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in fps)], names=["doc_id", "fp", *names])

    prints, _ = durable(two.mapInArrow(prints_of, ", ".join(["doc_id long", "fp long", *(f"{n} long" for n in names)])).where("doc_id is not null"), "fingerprints")
    first = prints.join(_grouped(prints, "fp", radius), "fp")
    placed, _ = durable(first.select("doc_id", *names, (F.col("doc_id") != F.col("component_id")).alias("gone")), "placed")
    left, gone = placed.where("not gone").drop("gone"), placed.where("gone").select("doc_id")
    for name in names:
        more = _gone(two, left, name, word_radius, similar, similar_shingle)
        left, gone = left.join(more, "doc_id", "left_anti"), gone.union(more)
    (own,) = unused(df.columns, "gone_id")
    gone, _ = durable(gone.distinct().select(F.col("doc_id").alias(own)), "gone")
    return df.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(own), "left_anti")
