"""Exact long-passage dedup with sparse suffix arrays.

Suffixes are kept only at minimiser positions: of every ``min_words - anchor +
1`` consecutive runs of ``anchor`` words, the (first) one with the least hash.
The choice depends on the words alone, so two copies of a passage of
``min_words`` words keep a suffix at the same place in it, and every run of
``min_words`` words belongs to one kept suffix.

1. Suffixes whose first ``anchor`` words (by digest) stand in no other document
   are left out.
2. The others are dealt by that digest and sorted by the words that follow it;
   neighbours are compared word by word, which gives their common prefixes.
   The matches are extended to the left the same way, over the words in front
   read backwards.  Two runs are equal where their suffixes agree far enough
   to both sides, and the least document of each such group is sent back.
3. Each document's runs with a smaller document are joined to spans.

Suffixes carry as many words to each side as their runs reach, as 48-bit
numbers; equal ones of a block are sent once.  Beginnings that more than
``HOT`` suffixes share would be one large group; the runs around those are
compared by 96-bit digests instead, which spreads them evenly, and the result
is the same.

What is reported: the words of a document that lie in a run of ``min_words``
words which also occurs in a document with a smaller id.

Defined cases: null texts, empty texts and those shorter than ``min_words``
have no spans; rows with a null id are left out, as no id is smaller or larger
than null; rows that share an id count as one document; a passage that repeats
only within one document is not reported; a text of any length is taken whole;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .blocks import Block, blocks_in, pack
from .storage import durable
from .substring_dedup import exact_entries
from .wordhash import window_hashes, word_bounds, word_hashes

MIN_WORDS = 50
ANCHOR = 25
#: Suffixes with the same beginning that are sorted together at most.
HOT = 1024
#: Suffixes that the owner of a range holds at once.
RANGE_SUFFIXES = 50_000
SPANS = "doc_id long, first_doc_id long, start_word long, n_words long"
#: Bytes of a word's number.
_WORD = 6
ALONE, SHARED, MANY = 0, 1, 2


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the (first) least value of every run of ``width`` values stands."""
    span, best = 1, np.arange(len(values))
    while span < width:
        hop = min(span, width - span)
        if len(best) <= hop:
            return best[:0]
        a, b = best[:-hop], best[hop:]
        best = np.where(values[b] < values[a], b, a)
        span += hop
    return best


class Suffixes:
    """Words of a block, its runs of ``size`` words, and the suffix (minimiser) that each run belongs to.

    Runs: ``at`` (first word) and ``own`` (number of the suffix).  Suffixes:
    ``pos``, ``key`` (digest of the first words), ``doc`` and, as distances
    from ``pos`` back to the first word of a run, ``low`` to ``high``.
    """

    def __init__(self, block: Block, size: int, anchor: int):
        self.block, self.size, self.anchor = block, size, anchor
        self.starts, self.ends = word_bounds(block.buf)
        self.words = word_hashes(block.buf, self.starts, self.ends, 0)
        self.word_doc = np.searchsorted(block.ends, self.starts, side="right")
        n = max(0, len(self.words) - size + 1)
        self.at = np.flatnonzero(self.word_doc[:n] == self.word_doc[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)
        grams = window_hashes(self.words, anchor, 0)
        least = sliding_argmin(grams, size - anchor + 1)[self.at] if len(self.at) else np.zeros(0, np.int64)
        heads = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.zeros(0, np.int64)
        self.own = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(least))))
        self.pos = least[heads]
        self.key = grams[self.pos]
        self.doc = block.ids[self.word_doc[self.pos]]
        self.high = self.pos - self.at[heads]
        self.low = self.pos - self.at[np.append(heads[1:], len(least)) - 1] if len(heads) else self.high

    def _second(self, size: int) -> np.ndarray:
        """The rest of the 96-bit digests of all runs of ``size`` words."""
        return (window_hashes(word_hashes(self.block.buf, self.starts, self.ends, 1), size, 1) >> np.uint64(32)).astype(np.uint32)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct beginnings in order, each with 1 or 2 for one or more documents and its number of suffixes."""
        order = np.lexsort((self.doc, self.key))
        k, d = self.key[order], self.doc[order]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        end = np.append(head[1:], len(k))[: len(head)]
        return k[head], 1 + (d[head] != d[end - 1]).astype(np.uint8), (end - head).astype(np.uint32)

    def entries(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct entries of the chosen suffixes in order of their keys: keys, rows, least documents; and each suffix's place among them.

        A row is the digest's second part, the distances, and the words that
        follow and that stand in front (backwards), zeros beyond its runs.
        """
        reach = self.size - self.anchor
        pos, low, high = self.pos[chosen], self.low[chosen], self.high[chosen]
        number = (self.words >> np.uint64(16)) | np.uint64(1)
        step = np.arange(reach)

        def context(places: np.ndarray, many: np.ndarray) -> np.ndarray:
            words = np.where(step[None, :] < many[:, None], number[np.clip(places, 0, len(number) - 1)], np.uint64(0))
            return words.view(np.uint8).reshape(len(chosen), reach, 8)[:, :, :_WORD].reshape(len(chosen), reach * _WORD)

        after = context(pos[:, None] + self.anchor + step[None, :], reach - low)
        before = context(pos[:, None] - 1 - step[None, :], high)
        second = self._second(self.anchor)[pos]
        head = np.empty(len(chosen), dtype=[("key", ">u8"), ("second", "<u4"), ("low", "<u2"), ("high", "<u2")])
        head["key"], head["second"], head["low"], head["high"] = self.key[chosen], second, low, high
        whole = np.concatenate([head.view(np.uint8).reshape(len(chosen), head.itemsize), after, before], axis=1)
        rows, place = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").reshape(-1), return_inverse=True)
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, place, self.doc[chosen])
        flat = rows.view(np.uint8).reshape(len(rows), whole.shape[1])
        keys = np.ascontiguousarray(flat[:, :8]).view(">u8").reshape(-1).astype(np.uint64)
        return keys, np.ascontiguousarray(flat[:, 8:]).view(f"V{whole.shape[1] - 8}").reshape(-1), least, place

    def digests(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96-bit digests of the chosen runs."""
        return window_hashes(self.words, self.size, 0)[self.at[runs]], self._second(self.size)[self.at[runs]]


def _kinds(keys: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """For every beginning: does it stand in several documents, and in how many suffixes?"""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    docs, many = (np.add.reduceat(c[order].astype(np.int64), head) if len(head) else head for c in columns)
    kind = np.where(docs < 2, ALONE, np.where(many > HOT, MANY, SHARED)).astype(np.uint8)
    out = np.empty(len(keys), dtype=np.uint8)
    out[order] = np.repeat(kind, np.diff(np.append(head, len(ranked))))
    return out


def common_prefixes(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``words`` in order within their groups, and how many first words each has in common with the one before it (-1: other group)."""
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), group))
    own, g = words[order], group[order]
    common = np.full(len(order), -1, dtype=np.int64)
    if len(order):
        common[1:] = np.cumprod(own[1:] == own[:-1], axis=1).sum(axis=1)
        common[1:][g[1:] != g[:-1]] = -1
    return order, common


def extended(keys: np.ndarray, columns: list[np.ndarray], reach: int) -> np.ndarray:
    """For every suffix and every distance back to the first word of a run: the least document with the same run (0 where it has no such run)."""
    rows, docs = columns
    flat = rows.view(np.uint8).reshape(len(rows), 8 + 2 * reach * _WORD)
    head = np.ascontiguousarray(flat[:, :8]).view([("second", "<u4"), ("low", "<u2"), ("high", "<u2")]).reshape(-1)
    low, high = head["low"].astype(np.int64), head["high"].astype(np.int64)
    group = exact_entries(keys, head["second"], docs)[3]

    def words(at: int) -> np.ndarray:
        wide = np.zeros((len(rows), reach, 8), dtype=np.uint8)
        wide[:, :, :_WORD] = flat[:, at : at + reach * _WORD].reshape(len(rows), reach, _WORD)
        return wide.view(np.uint64).reshape(len(rows), reach)

    after, after_common = common_prefixes(words(8), group)
    before, before_common = common_prefixes(words(8 + reach * _WORD), group)
    least = np.zeros((len(rows), reach + 1), dtype=np.int64)
    right, left = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
    for back in range(reach + 1):
        # neighbours with so many words in common are one class to the right, and to the left
        right[after] = np.cumsum(after_common < reach - back)
        left[before] = np.cumsum(before_common < back)
        mine = np.flatnonzero((low <= back) & (back <= high))
        if len(mine):
            code = right[mine] * (len(rows) + 1) + left[mine]
            order = np.argsort(code, kind="stable")
            ranked = code[order]
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            least[mine[order], back] = np.repeat(np.minimum.reduceat(docs[mine[order]], first), np.diff(np.append(first, len(order))))
    return least


def _emit(size: int, anchor: int, ranges: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for number, block in blocks_in(pdf):
                keys, docs, many = Suffixes(block, size, anchor).anchors()
                if rows := list(X.deal(number, keys, [docs, many], ranges)):
                    yield pd.DataFrame(rows)

    return run


def _by_kind(s: Suffixes, said: pd.DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes to be sorted, and runs to be compared by digests."""
    keys, _, _ = s.anchors()
    kind = X.answers(said, [keys], ranges, np.uint8)[0][np.searchsorted(keys, s.key)] if len(keys) else np.zeros(0, np.uint8)
    return np.flatnonzero(kind == SHARED), np.flatnonzero(kind[s.own] == MANY) if len(kind) else np.zeros(0, np.int64)


def _deal(size: int, anchor: int, ranges: int, shares: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, block in blocks_in(left):
            s = Suffixes(block, size, anchor)
            sorted_, hot = _by_kind(s, right, ranges)
            if len(sorted_):
                keys, rows, docs, _ = s.entries(sorted_)
                out += X.deal(number, keys, [rows, docs], shares)
            if len(hot):
                a, b, d, _ = exact_entries(*s.digests(hot), s.doc[s.own[hot]])
                out += X.deal(number, a, [b, d], shares, 1)
        return pd.DataFrame(out, columns=["owner", "block", "n", "keys", "more"])

    return run


def _spans(size: int, anchor: int, ranges: int, shares: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in blocks_in(left):
            s = Suffixes(block, size, anchor)
            sorted_, hot = _by_kind(s, right[right["pass"] == 1], ranges)
            said = right[right["pass"] == 2]
            first = s.doc[s.own]
            if len(sorted_):
                keys, _, _, place = s.entries(sorted_)
                wide = 8 * (size - anchor + 1)
                least = X.answers(said, [keys], shares, np.dtype(f"V{wide}"))[0].view(np.int64).reshape(len(keys), wide // 8)
                at = np.full(len(s.pos), -1)
                at[sorted_] = place
                runs = np.flatnonzero(at[s.own] >= 0)
                first[runs] = least[at[s.own[runs]], s.pos[s.own[runs]] - s.at[runs]]
            if len(hot):
                a, _, _, place = exact_entries(*s.digests(hot), s.doc[s.own[hot]])
                first[hot] = X.answers(said.assign(owner=said["owner"] - shares), [a], shares, np.int64)[0][place]
            hit = np.flatnonzero(first < s.doc[s.own])
            if not len(hit):
                continue
            at, first, local = s.at[hit], first[hit], s.word_doc[s.at[hit]]
            new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (first[1:] != first[:-1]) | (local[1:] != local[:-1])))
            end = np.append(new[1:], len(at)) - 1
            base = np.searchsorted(s.word_doc, local[new])
            out.append(pd.DataFrame({"doc_id": block.ids[local[new]], "first_doc_id": first[new], "start_word": at[new] - base, "n_words": at[end] - at[new] + size}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in SPANS.split(", ")})

    return run


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, first_doc_id, start_word, n_words``: maximal spans whose runs of ``min_words`` words first occur in ``first_doc_id``.

    Spans of one document may overlap where their first documents differ.
    """
    if not 0 < anchor <= min_words:
        raise ValueError("anchor must be between 1 and min_words")
    blocks, _ = pack(df, id_col, text_col)
    total = blocks.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("n")).first()["n"]
    reach = min_words - anchor
    suffixes = total // 6 // max(1, reach // 2)
    ranges = X.ranges_for(blocks, suffixes, 0, total)
    shares = X.ranges_for(blocks, suffixes, RANGE_SUFFIXES, total)
    # the answers are small and used by both later passes
    told = X.resolve(blocks.mapInPandas(_emit(min_words, anchor, ranges.coarse), X.BLOB), ranges, (_kinds, [np.uint8, np.uint32]), kinds=(np.uint8,))
    kinds, _ = durable(told, "anchors")
    dealt = blocks.groupBy("block").cogroup(kinds.groupBy("block")).applyInPandas(_deal(min_words, anchor, ranges.coarse, shares.coarse), X.BLOB)
    row, wide = np.dtype(f"V{8 + 2 * reach * _WORD}"), np.dtype(f"V{8 * (reach + 1)}")
    sorted_ = lambda keys, more: np.ascontiguousarray(extended(keys, more, reach)).view(wide).reshape(-1)
    least = X.resolve(dealt, shares, (sorted_, [row, np.int64]), (lambda keys, more: X.least_doc(keys, *more), [np.uint32, np.int64]), kinds=(wide, np.int64))
    said = kinds.withColumn("pass", F.lit(1)).union(least.withColumn("pass", F.lit(2)))
    return blocks.groupBy("block").cogroup(said.groupBy("block")).applyInPandas(_spans(min_words, anchor, ranges.coarse, shares.coarse), SPANS)


def remove_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept``: the texts without the words of their spans, joined by one space."""
    cuts = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("cuts"))
    words = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), words.alias("words")).where("doc_id is not null").join(cuts, "doc_id", "left")
    kept = F.expr("filter(words, (w, i) -> cuts is null or not exists(cuts, c -> i >= c.start_word and i < c.start_word + c.n_words))")
    return own.select("doc_id", F.array_join(kept, " ").alias("kept"))
