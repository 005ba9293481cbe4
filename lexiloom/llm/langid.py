"""Language identification with segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary.  Each language has a
probability for each piece; a word's probability is the sum over all of its
segmentations into pieces, by the forward algorithm; a text's is the product
over its words.  Piece probabilities come from expectation-maximisation over
word counts: the first pass starts from equal probabilities, every pass takes
expected piece counts from the forward-backward algorithm.

The classifier is fitted on a bounded sample of labelled rows: about
``docs_per_lang`` documents of each language, chosen by a hash of the id.  The
model holds languages x pieces numbers whatever the size of the corpus; more
than ``MAX_LANGS`` labels, or ``MAX_CELLS`` numbers, raise.  Prediction covers every text whole; words are
scored once for each worker and kept in a cache of bounded size.

Words are segmented whole, whatever their length: many short ones at once, and
those beyond ``SHORT`` characters, whose probabilities leave the range of
doubles, one by one with the forward values scaled on the way.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
words without letters say nothing; characters outside the vocabulary cost
every language the same; ties go to the language that sorts first; a training
set without labelled texts makes every prediction ``und``, as does an empty
one; the id may be null (the row is held in) or repeat; columns of the input
named as the two that are added give way to them (:func:`keep_known` adds none
and keeps all); other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop_path, durable, once_a_worker, slices
from .wordhash import mix

DOCS_PER_LANG = 600
ROUNDS = 2
#: Longest words (with their mark) that are segmented together, and how many at once.
SHORT, BATCH = 41, 4000
CACHE_WORDS = 120_000
#: Longest words that are kept in the cache.
CACHE_CHARS = 200
MAX_LANGS = 10_000
#: Numbers of a model (languages x pieces) that are sent to every worker: 320 MB.
MAX_CELLS = 40_000_000
#: Probability of a character that the vocabulary lacks, and the smoothing mass of each piece.
FLOOR, ALPHA = 1e-7, 0.05

_TOKENS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LETTER = regex.compile(r"\p{L}")


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model, with a leading space for the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return list(dict.fromkeys(p.replace("▁", " ") for p in pieces))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _TOKENS.findall(text.lower()) if text else []


class Lattice:
    """The segmentations of many words at once.

    Pieces are looked up by rolling hashes of all substrings, one vector
    operation for each (start, length); the table is open-addressed and keeps
    the full 64-bit hashes.
    """

    BITS = 20
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.keys = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.values = np.full(1 << self.BITS, -1, dtype=np.int64)
        self.probes = 1
        found = np.zeros(len(pieces), dtype=np.uint64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            codes = np.frombuffer("".join(pieces[i] for i in own.tolist()).encode("utf-32-le"), dtype=np.uint32).reshape(len(own), n)
            h = np.zeros(len(own), dtype=np.uint64)
            for j in range(n):
                h = h * self.BASE + (codes[:, j] + np.uint64(1))
            found[own] = mix(h)
        for i, (key, at) in enumerate(zip(found.tolist(), (found >> np.uint64(64 - self.BITS)).tolist(), strict=True)):
            steps = 1
            while self.values[at] >= 0:
                at, steps = (at + 1) % len(self.keys), steps + 1
            self.keys[at], self.values[at] = key, i
            self.probes = max(self.probes, steps)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, or -1."""
        keys = mix(hashes)
        at = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        for step in range(1, self.probes):
            left = np.flatnonzero((out < 0) & (self.values[(at + step - 1) % len(self.keys)] >= 0))
            if not len(left):
                break
            spot = (at[left] + step) % len(self.keys)
            out[left] = np.where(self.keys[spot] == keys[left], self.values[spot], -1)
        return out

    def edges(self, parts: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) in order of start, then end; piece -1 is a character of no piece.

        ``parts`` are in ascending order of length.
        """
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(size[-1]) if len(parts) else 0
        codes = np.zeros((width, len(parts)), dtype=np.uint64)
        flat = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        row = np.repeat(np.arange(len(parts)), size)
        codes[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), row] = flat + np.uint32(1)
        out = []
        for i in range(width):
            first = int(np.searchsorted(size, i, side="right"))
            h = np.zeros(len(parts) - first, dtype=np.uint64)
            for j in range(i + 1, min(width, i + self.longest) + 1):
                skip = int(np.searchsorted(size, j)) - first  # these rows end before j
                h, first = h[skip:], first + skip
                h = h * self.BASE + codes[j - 1, first:]
                pieces = self._find(h)
                rows = np.arange(len(pieces)) if j == i + 1 else np.flatnonzero(pieces >= 0)
                if len(rows):
                    out.append((i, j, rows + first, pieces[rows]))
        return out


    def spans(self, word: str) -> np.ndarray:
        """``[j, n - 1]``: the piece of ``word[j - n : j]``; -1 for a character of no piece, -2 for other spans of none."""
        codes = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        out = np.full((len(codes) + 1, min(self.longest, max(1, len(codes)))), -2, dtype=np.int32)
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, out.shape[1] + 1):
            h = h[: len(codes) - n + 1] * self.BASE + codes[n - 1 :]
            pieces = self._find(h)
            out[n:, n - 1] = pieces if n == 1 else np.where(pieces < 0, -2, pieces)
        return out


def _batches(words: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(word number, marked word) of short words in ascending order of length, a batch at a time."""
    short = sorted(((k, " " + w) for k, w in enumerate(words) if len(w) < SHORT), key=lambda x: len(x[1]))
    for at in range(0, len(short), BATCH):
        yield short[at : at + BATCH]


def _long(words: list[str]) -> Iterator[tuple[int, str]]:
    return ((k, " " + w) for k, w in enumerate(words) if len(w) >= SHORT)


def _sweep(spans: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward values of one word: ``values[j, lang] * exp(logs[j, lang])`` sums the segmentations of its first ``j`` characters.

    ``table`` has a last row of zeros for spans of no piece.  Every sixteen
    steps the values that are still needed are scaled to about one, for each
    language by itself.
    """
    n, widest = len(spans) - 1, spans.shape[1]
    values, logs = np.zeros((n + 1, table.shape[1])), np.zeros((n + 1, table.shape[1]))
    values[0] = 1.0
    for j in range(1, n + 1):
        k = min(widest, j)
        values[j] = (table[spans[j, :k]] * values[j - k : j][::-1]).sum(axis=0)
        logs[j] = logs[j - 1]
        if j % 16 == 0:
            by = values[j].copy()
            first = max(0, j - widest + 1)
            # earlier values are no longer read here; those that are get one common scale
            values[first : j + 1] *= np.exp(logs[first : j + 1] - logs[j]) / by
            logs[first : j + 1] = logs[j] + np.log(by)
    return values, logs


@dataclass
class Model:
    """``langs`` in order and ``probs[piece, lang]``."""

    langs: list[str]
    pieces: list[str]
    probs: np.ndarray

    def __post_init__(self):
        self.lattice = Lattice(self.pieces)
        self.table = np.vstack([self.probs, np.full((1, len(self.langs)), FLOOR)])  # the last row is piece -1
        self.padded = np.vstack([self.table, np.zeros((1, len(self.langs)))])  # and here no piece

    def _spans(self, word: str) -> np.ndarray:
        """Rows of ``padded``."""
        found = self.lattice.spans(word)
        return np.where(found >= 0, found, np.where(found == -1, len(self.pieces), len(self.pieces) + 1))

    def _forward(self, parts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        edges = self.lattice.edges(parts)
        alpha = np.zeros((max(map(len, parts), default=0) + 1, len(parts), len(self.langs)))
        alpha[0] = 1.0
        for i, j, rows, pieces in edges:
            alpha[j, rows] += alpha[i, rows] * self.table[pieces]
        ends = np.fromiter(map(len, parts), np.int64, len(parts))
        return edges, alpha, np.maximum(alpha[ends, np.arange(len(parts))], 1e-300)

    def log_probs(self, words: list[str]) -> np.ndarray:
        """log P(word | language) of each word, summed over all segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        for parts in _batches(words):
            out[[k for k, _ in parts]] = np.log(self._forward([p for _, p in parts])[2])
        for k, word in _long(words):
            values, logs = _sweep(self._spans(word), self.padded)
            out[k] = np.log(values[-1]) + logs[-1]
        return out

    def expect(self, words: list[str], weights: np.ndarray, into: np.ndarray) -> None:
        """Add the expected piece counts of words; ``weights[word, lang]``."""
        for parts in _batches(words):
            edges, alpha, total = self._forward([p for _, p in parts])
            share = weights[[k for k, _ in parts]] / total
            beta = np.zeros_like(alpha)
            beta[np.fromiter((len(p) for _, p in parts), np.int64, len(parts)), np.arange(len(parts))] = 1.0
            for i, j, rows, pieces in reversed(edges):
                step = self.table[pieces] * beta[j, rows]
                np.add.at(into, pieces, share[rows] * alpha[i, rows] * step)
                beta[i, rows] += step
        for k, word in _long(words):
            spans = self._spans(word)
            n = len(spans) - 1
            values, logs = _sweep(spans, self.padded)
            # the same sweep from the end: a span of reversed characters ends where it began
            back = np.full_like(spans, len(self.pieces) + 1)
            for size in range(1, spans.shape[1] + 1):
                back[size:, size - 1] = spans[size:, size - 1][::-1]
            after, after_logs = (x[::-1] for x in _sweep(back, self.padded))
            total = np.log(values[-1]) + logs[-1]
            for size in range(1, spans.shape[1] + 1):
                pieces = spans[size:, size - 1]
                real = np.flatnonzero(pieces <= len(self.pieces))
                i, j = real, real + size
                got = values[i] * after[j] * np.exp(logs[i] + after_logs[j] - total) * self.padded[pieces[real]]
                np.add.at(into, pieces[real], weights[k] * got)


def _load(parts: tuple) -> Model:
    return Model(*parts)


def _flat(pieces: list[str], langs: list[str]) -> Model:
    return Model(langs, pieces, np.full((len(pieces), len(langs)), 1.0 / max(1, len(pieces))))


def fit(labelled: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS) -> Model:
    """Fit on about ``docs_per_lang`` rows of each language of ``labelled`` (rows without label or text do not count)."""
    spark = labelled.sparkSession
    pieces = vocabulary_pieces(path)
    rows = labelled.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}  # one row a language
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} labels")
    if len(counts) * len(pieces) > MAX_CELLS:
        raise ValueError(f"{len(counts)} labels and {len(pieces)} pieces make more than {MAX_CELLS} numbers")
    langs = sorted(counts)
    if not langs:
        return _flat(pieces, [])
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_lang / counts[lang]))])
    rank = F.shiftrightunsigned(F.xxhash64(F.coalesce("id", F.lit(0)), F.lit("langid")), 11) / F.lit(float(1 << 53))
    sample = rows.where(rank < share[F.col("lang")]).select("lang", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for k, c in seen.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(c), pa.string()), "word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > CACHE_WORDS:
                yield from told()
                seen = {}
        yield from told()

    # distinct words of a bounded sample
    words, path = durable(sample.mapInArrow(tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words", docs_per_lang * len(langs) * 100)
    place = {lang: i for i, lang in enumerate(langs)}
    model = _flat(pieces, langs)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((langs, pieces, model.probs))  # pieces x languages numbers

        def expected(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            now = once_a_worker(shared, _load)
            got = np.zeros_like(now.table)
            for pdf in frames:
                weights = np.zeros((len(pdf), len(now.langs)))
                weights[np.arange(len(pdf)), pdf["lang"].map(place)] = pdf["n"]
                now.expect(list(pdf["word"]), weights, got)
            p, k = np.nonzero(got[:-1])
            yield pd.DataFrame({"piece": p, "lang": k, "n": got[p, k]})

        total = words.mapInPandas(expected, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # at most pieces x languages
        probs = np.full(model.probs.shape, ALPHA)
        probs[total["piece"], total["lang"]] += total["n"]
        model = Model(langs, pieces, probs / probs.sum(axis=0))
    drop_path(spark, path)
    return model


class _Scorer:
    """Predictions for batches of texts; log probabilities of words are kept."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((1024, len(model.langs)))

    def _known(self, fresh: list[str]) -> None:
        first = len(self.rows)
        self.rows.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        while len(self.rows) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : len(self.rows)] = self.model.log_probs(fresh)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        preds, scores, langs = [], [], self.model.langs
        found = [words_of(text) if langs else [] for text in texts]
        if len(self.rows) > CACHE_WORDS:
            self.rows = {}
        fresh = {w for words in found for w in words if w not in self.rows}
        large = sorted(w for w in fresh if len(w) > CACHE_CHARS)
        self._known([w for w in fresh if len(w) <= CACHE_CHARS])
        apart = dict(zip(large, self.model.log_probs(large), strict=True)) if large else {}
        for words in found:
            if not words:
                preds.append("und")
                scores.append(0.0)
                continue
            total = self.table[[self.rows[w] for w in words if w in self.rows]].sum(axis=0)
            for w in words if apart else ():
                total = total + apart.get(w, 0.0)
            best = int(np.argmax(total))
            preds.append(langs[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return preds, scores


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (posterior of the language over equal priors) appended."""
    names = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    rows = df.select(*(F.col(f"`{c}`") for c in names))
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.probs))  # pieces x languages numbers
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(once_a_worker(shared, _load))
        for batch in slices(batches):
            preds, scores = score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def keep_known(df: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a letter and a predicted language of at least ``min_score``, with all their columns, whatever their names."""
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.probs))  # pieces x languages numbers
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(once_a_worker(shared, _load))
        for batch in slices(batches):
            preds, scores = score(batch.column(at).to_pylist())
            yield batch.filter(pa.array([p != "und" and x >= min_score for p, x in zip(preds, scores, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))
