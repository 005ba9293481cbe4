"""Alignment of two tokenizers' tokens over the bytes of the same text.

Each text, with a space in front, is encoded by A (byte-level BPE of the
tokenizers library) and by B (a sentencepiece model, which adds that space
itself).  Every byte gets its owner, the index of the token that covers it, once
for A and once for B.  Where either owner changes, a pair of overlapping tokens
ends; where both change together, a cut lies between two groups, and the two
tokens that end there are linked.

How often two ids are linked is counted over the whole corpus.  Tokens that end
together are one a suffix of the other, so the pairs that can ever be linked are
given by the two vocabularies (some half a million for usual ones, refused beyond
``MOST_PAIRS``): tasks add up their pairs, Spark sums them, and the sums go back
to every task.  Texts are encoded once, into blocks of links in the shared
folder, and never shuffled.

Defined cases: null and empty texts, and texts whose joined token bytes of A or
B are not the text with a space in front, have no tokens: all zeros, an empty
digest, no links; special tokens that stand in a text are ordinary text; rows
with a null id are kept with it; repeated rows count again; a text of any length
is aligned whole; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import expand, squeeze
from .bpe import _planes, _unplanes
from .pretokens import STOP, gather
from .storage import durable, once_a_worker, slices
from .token_store import CachedEncoder

#: Pairs of ids that the two vocabularies may link at most.
MOST_PAIRS = 8_000_000
#: Bytes of text that are aligned together.
GROUP = 1 << 20

_BLOCKS = "ids binary, no_id binary, n_a binary, n_b binary, n_groups binary, digests binary, pairs binary, counts binary, places binary"
_SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OVERLAPS = "doc_id long, a_at int, b_at int, a int, b int, start long, end long, linked boolean"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a tokenizers file; added tokens are their own text."""
    from tokenizers import Tokenizer

    library, of = Tokenizer.from_file(path), byte_characters()
    added = {i: t.content.encode() for i, t in library.get_added_tokens_decoder().items()}
    ids = library.get_vocab(with_added_tokens=True)
    out = [b""] * (max(ids.values(), default=-1) + 1)
    for token, i in ids.items():
        out[i] = added[i] if i in added else bytes(of[c] for c in token)
    return out


def piece_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a sentencepiece model."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(library.id_to_piece(i), library.is_byte(i)) for i in range(library.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if single else p.replace("▁", " ").encode() for p, single in pieces]


def possible_links(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together: one is a suffix of the other."""
    ids = [defaultdict(int), defaultdict(int)]
    for tokens, known in zip((a, b), ids, strict=True):
        for t in tokens:
            known[t] += bool(t)
    shorter = sum(ids[1].get(t[i:], 0) for t in a for i in range(len(t)))
    return shorter + sum(ids[0].get(t[i:], 0) for t in b for i in range(1, len(t)))


def _space_points(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of spaces with what follows them; each text starts with a space."""
    stop = codes == STOP
    space = codes == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    begins = np.flatnonzero(start | stop)
    ends, ink = np.append(begins[1:], len(codes)), ~stop[begins]
    return begins[ink], ends[ink]


class PieceEncoder(CachedEncoder):
    """A sentencepiece model, asked once for each distinct run of spaces with its word.

    That gives the ids of whole texts as long as no piece goes on with a space
    after another character; a model with such pieces gets whole texts.
    """

    split = staticmethod(_space_points)
    cache_words, cache_bits = 600_000, 20

    def __init__(self, path: str):
        import sentencepiece

        self.library, self.added = sentencepiece.SentencePieceProcessor(model_file=path), []
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        #: ids of one space behind a word
        self.space = self.library.encode("a ")[len(self.library.encode("a")) :]
        self._clear()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.library.encode([w[1:] for w in words], num_threads=1)
        coded = [ids if len(w) > 1 else self.space for w, ids in zip(words, coded, strict=True)]
        return np.array([i for ids in coded for i in ids], dtype=np.uint32), np.fromiter(map(len, coded), np.int64, len(coded))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, which starts with the space that the model adds."""
        if self.apart:
            return self._encode_plain(texts)
        return [np.array(self.library.encode(t[1:]) if t else [], dtype=np.uint32) for t in texts]


class PlainEncoder(CachedEncoder):
    """A byte-level vocabulary whose special tokens are ordinary text."""

    cache_words, cache_bits = 600_000, 20

    def __init__(self, path: str):
        super().__init__(path, plain=True)


class Tokens:
    """The tokens of a vocabulary by id: their bytes in a row, and their ids in decimal."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        width = len(str(max(1, len(tokens) - 1)))
        digits = "".join(str(i).rjust(width, "\0") for i in range(len(tokens)))
        self.digits = np.frombuffer(digits.encode(), np.uint8).reshape(len(tokens), width)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.starts, self.sizes, ids.astype(np.int64))[0]


@dataclass
class Aligned:
    """Texts laid end to end: counts by text, ids of all tokens, and index pairs of overlapping tokens with their last byte."""

    n_a: np.ndarray
    n_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray
    last: np.ndarray
    cut: np.ndarray

    @property
    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the two tokens that end at each cut."""
        return self.over_a[self.cut], self.over_b[self.cut]


class Aligner:
    """Two encoders with their vocabularies, kept by a worker."""

    def __init__(self, a_path: str, b_path: str):
        self.encoders = PlainEncoder(a_path), PieceEncoder(b_path)
        self.tokens = Tokens(byte_level_tokens(a_path)), Tokens(piece_tokens(b_path))

    def align(self, texts: list[str | None]) -> Aligned:
        spaced = [" " + t if t else None for t in texts]
        said = [np.frombuffer(t.encode(), np.uint8) if t else np.zeros(0, np.uint8) for t in spaced]
        size = np.fromiter(map(len, said), np.int64, len(said))
        ids = [e.encode_batch(spaced) for e in self.encoders]
        good = size > 0
        for own, table in zip(ids, self.tokens, strict=True):
            good &= np.fromiter((int(table.sizes[x].sum()) for x in own), np.int64, len(own)) == size
        for own, table in zip(ids, self.tokens, strict=True):
            some = np.flatnonzero(good).tolist()
            if some:
                differ = np.concatenate([said[k] for k in some]) != table.spell(np.concatenate([own[k] for k in some]))
                good[np.array(some)[np.unique(np.searchsorted(np.cumsum(size[some]), np.flatnonzero(differ), side="right"))]] = False
        n_a, n_b = (np.fromiter((len(x) if ok else 0 for x, ok in zip(own, good, strict=True)), np.int64, len(own)) for own in ids)
        a, b = (np.concatenate([np.zeros(0, np.uint32), *[x for x, ok in zip(own, good, strict=True) if ok]]) for own in ids)
        owner_a, owner_b = (np.repeat(np.arange(len(x), dtype=np.int32), t.sizes[x]) for x, t in zip((a, b), self.tokens, strict=True))
        # a byte after which an owner changes; both change where a text ends
        new_a, new_b = (np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in (owner_a, owner_b))
        last = np.flatnonzero(new_a | new_b)
        return Aligned(n_a, n_b, a, b, owner_a[last], owner_b[last], last, (new_a & new_b)[last])

    def spelled_groups(self, got: Aligned) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of every text in a row, and where each text's part ends."""
        end_a, end_b = (x.astype(np.int64) for x in got.linked)
        index_a, index_b = np.arange(len(got.a)), np.arange(len(got.b))
        group_a, group_b = np.searchsorted(end_a, index_a), np.searchsorted(end_b, index_b)
        width = max(t.digits.shape[1] for t in self.tokens)
        out = np.zeros((len(got.a) + len(got.b), width + 1), dtype=np.uint8)
        place_a = index_a + np.append(0, end_b + 1)[group_a]  # behind all tokens of earlier groups
        place_b = index_b + (end_a + 1)[group_b]  # and behind those of A in the own group
        for place, ids, table in zip((place_a, place_b), (got.a, got.b), self.tokens, strict=True):
            out[place, width - table.digits.shape[1] : width] = table.digits[ids]
        out[place_a, width], out[place_b, width] = ord(","), ord(",")
        out[place_a[end_a], width], out[place_b[end_b], width] = ord("|"), ord(";")
        tokens = np.cumsum(got.n_a + got.n_b)
        out[tokens[(got.n_a + got.n_b) > 0] - 1, width] = 0  # nothing behind a text's last group
        ink = out != 0
        return out[ink].tobytes(), np.append(0, np.cumsum(ink.sum(axis=1)))[tokens]


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """A worker's encoders, kept from task to task."""
    if (a_path, b_path) not in _aligners:
        _aligners.clear()
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        wide = len(aligner.tokens[1].sizes)
        for batch in slices(batches, 1000, GROUP):
            ids = batch.column(0).to_pylist()
            got = aligner.align(batch.column(1).to_pylist())
            at_a, at_b = got.linked
            groups = np.diff(np.append(0, np.searchsorted(at_a, np.cumsum(got.n_a))))
            spelled, ends = aligner.spelled_groups(got)
            digests = [hashlib.sha256(spelled[i:j]).digest() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            pairs, places, counts = np.unique(got.a[at_a].astype(np.int64) * wide + got.b[at_b], return_inverse=True, return_counts=True)
            often = np.argsort(-counts, kind="stable")  # small numbers for frequent pairs pack well
            rank = np.empty(len(often), dtype=np.int32)
            rank[often] = np.arange(len(often), dtype=np.int32)
            row = (
                np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], bool).tobytes(), got.n_a.tobytes(), got.n_b.tobytes(), groups.astype(np.int64).tobytes(),
                b"".join(digests), squeeze(pairs[often].tobytes()), squeeze(counts[often].astype(np.int64).tobytes()), _planes(rank[places]),
            )
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    return run


def _two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def blocks_of_links(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A durable table of ``df``'s links: a row for about ``GROUP`` bytes of text."""
    return durable(_two(df, id_col, text_col).mapInArrow(_align(a_path, b_path), _BLOCKS), "links")[0]


def link_counts(blocks: DataFrame, b_size: int) -> DataFrame:
    """``a, b, links, best`` of every linked pair of ids: how many links hold it, and whether none of ``b`` has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(expand(x), np.int64)) for x in (pairs, counts)], names=["pair", "n"])

    summed = blocks.select("pairs", "counts").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("links"))
    named = summed.select(F.expr(f"cast(pair div {b_size} as int)").alias("a"), (F.col("pair") % b_size).cast("int").alias("b"), "links")
    counts, _ = durable(named, "pairs")  # bounded by the vocabularies
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


class _Counts:
    """Sums by pair, sorted for look-up."""

    def __init__(self, columns: tuple[np.ndarray, ...]):
        self.pairs, self.links, self.best = columns

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.pairs, pairs)
        return self.links[at], self.best[at]


def summarize(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: tokens of A and B, groups, links, how many of those are the most frequent of their B id, the sum of their counts, and the digest of the groups."""
    a, b = byte_level_tokens(a_path), piece_tokens(b_path)
    if (bound := possible_links(a, b)) > MOST_PAIRS:
        raise ValueError(f"the vocabularies can link {bound} pairs; at most {MOST_PAIRS} are sent to every task")
    blocks = blocks_of_links(df, a_path, b_path, id_col, text_col)
    rows = link_counts(blocks, len(b)).toArrow()  # at most ``bound`` rows
    pairs = rows["a"].to_numpy().astype(np.int64) * len(b) + rows["b"].to_numpy()
    order = np.argsort(pairs)
    shared = df.sparkSession.sparkContext.broadcast((pairs[order], rows["links"].to_numpy()[order], rows["best"].to_numpy(zero_copy_only=False)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = once_a_worker(shared, _Counts)
        for batch in batches:
            for row in batch.to_pylist():
                ids, n_a, n_b, groups = (np.frombuffer(row[c], np.int64) for c in ("ids", "n_a", "n_b", "n_groups"))
                links, best = known.of(np.frombuffer(expand(row["pairs"]), np.int64))
                places = _unplanes(row["places"])
                ends = np.cumsum(groups)
                total, first = (np.append(0, np.cumsum(x[places], dtype=np.int64)) for x in (links, best))
                digests = [row["digests"][i * 32 : i * 32 + 32].hex() if n else "" for i, n in enumerate(n_a.tolist())]
                columns = [n_a, n_b, groups, groups, first[ends] - first[ends - groups], total[ends] - total[ends - groups]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=np.frombuffer(row["no_id"], bool)), *[pa.array(c, pa.int64()) for c in columns], pa.array(digests)], names=[c.split()[0] for c in _SUMMARY.split(", ")])

    return blocks.mapInArrow(run, _SUMMARY)


def overlaps(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every pair of overlapping tokens: their indices in the text, their ids, the bytes they share (from ``start`` up to ``end``, the space in front counted), and whether both end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for batch in slices(batches, 1000, GROUP):
            got = aligner.align(batch.column(1).to_pylist())
            text = np.searchsorted(np.cumsum(got.n_a), got.over_a, side="right")
            ahead_a, ahead_b = np.cumsum(got.n_a) - got.n_a, np.cumsum(got.n_b) - got.n_b
            reached = np.append(0, np.cumsum(aligner.tokens[0].sizes[got.a]))
            base = reached[ahead_a]
            end = got.last + 1
            start = np.append(0, end[:-1])[: len(end)]
            ids = batch.column(0).take(pa.array(text, pa.int64()))
            columns = [got.over_a - ahead_a[text], got.over_b - ahead_b[text], got.a[got.over_a], got.b[got.over_b]]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.int32)) for c in columns], pa.array(start - base[text]), pa.array(end - base[text]), pa.array(got.cut)], names=[c.split()[0] for c in _OVERLAPS.split(", ")])

    return _two(df, id_col, text_col).mapInArrow(run, _OVERLAPS)
