"""Text functions as Column builders.

All stay in the JVM but for entity unescaping with NFC and chrF, which Spark
lacks; those are Arrow UDFs, and unescaping is skipped for plain ASCII rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Character classes, markers and patterns that results depend on.
ZERO_WIDTH = "[\u200b-\u200f\u2060\ufeff]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
HORIZONTAL = "[\t\u00a0\u3000 ]+"
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CJK_BLOCKS = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
CJK_RANGE = "[\u3400-\u9fff]"
SENTENCE_ENDS = "。！？；"
NUMBER = r"(?:[0-9]+(?:\.[0-9]+)?)|[〇零一二三四五六七八九十百千万亿两壹贰叁肆伍陆柒捌玖拾佰仟]+"
NEGATION_MARKS = ("不", "无", "未", "非", "莫", "勿", "弗", "毋", "否", "不能", "不可")
SOURCE_NEGATIONS = "不|无|未|非|莫|勿|弗|毋|否"
OUTPUT_NEGATIONS = "并非|没有|尚未|不能|不可|不|无|未|非|莫|勿|弗|毋|否|没"
SOURCE_SPAN = r"(?s)原文[：:]\s*(.*?)\s*\n\s*译文[：:]"
TRANSLATION_TERMS = ("翻译", "译成", "译为", "今译", "白话", "现代汉语")
QUOTED = "[“「『\"]([^”」』\"]{2,})[”」』\"]"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def nonblank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def truthy(*columns: Column) -> Column:
    """The first column that is neither null nor the empty string."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


@F.pandas_udf(StringType())
def _unescape_nfc(text: pd.Series) -> pd.Series:
    import html
    import unicodedata

    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", html.unescape(x)))


def normalize_text(text: Column, entities: bool = True) -> Column:
    """Conservative normalisation: entities, line ends, NFC, invisible characters, spaces, blank lines.

    ``entities=False`` leaves out the only part that needs Python.
    """
    value = text
    if entities:
        plain = ~F.coalesce(value.rlike("[^\\x00-\\x7f]|&"), F.lit(False))
        value = F.when(plain, value).otherwise(_unescape_nfc(value))
    value = F.regexp_replace(value, "\r\n?", "\n")
    value = F.regexp_replace(value, f"{ZERO_WIDTH}|{CONTROL}", "")
    lines = F.transform(F.split(value, "\n"), lambda line: strip(F.regexp_replace(line, HORIZONTAL, " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def dedup_key(normalized: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(normalized), r"[^\p{L}\p{N}]+", "")


def lines_of(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, LINE_BREAKS), strip), lambda line: line != "")


def duplicate_line_ratio(text: Column) -> Column:
    """Share of lines that repeat an earlier one; 1 without lines."""
    return bound(lines_of(text), lambda lines: F.when(F.size(lines) == 0, 1.0).otherwise(1.0 - F.size(F.array_distinct(lines)) / F.size(lines)))


def compact(text: Column) -> Column:
    """Without Unicode white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def compact_length(text: Column) -> Column:
    return F.length(compact(text))


def cjk_ratio(text: Column, variant: str = "blocks") -> Column:
    """``blocks``: three blocks over visible characters; ``all``: one range over all; ``visible``: one range over visible."""
    pattern, size = {"blocks": (CJK_BLOCKS, compact_length(text)), "all": (CJK_RANGE, F.length(text)), "visible": (CJK_RANGE, compact_length(text))}[variant]
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(size, F.lit(1))


def has_run(text: Column, least: int) -> Column:
    """A character other than a line feed stands ``least`` times in a row."""
    return F.coalesce(text.rlike(rf"(?s)([^\n])\1{{{least - 1},}}"), F.lit(False))


def bound(value: Column, build) -> Column:
    """``build(value)`` with ``value`` computed once a row, even where ``build`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), build), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once a row.

    Spark copies a projected expression into all that use it, Python arguments
    and filters among them, but takes none out of a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def characters(text: Column) -> Column:
    """The code points of a text; unlike ``substring``, reaching one of them does not walk the text."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def ngrams(text: Column, size: int) -> Column:
    """All character n-grams in order; none if the text is shorter."""

    def build(c):
        n = F.size(c)
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.concat(*(F.get(c, i + k) for k in range(size))))).otherwise(F.array().cast("array<string>"))

    return bound(characters(text), build)


def repetition(text: Column, size: int = 4) -> Column:
    """1 - distinct / all n-grams (0 distinct of none counts as ratio 0 over 1)."""
    return bound(ngrams(text, size), lambda grams: 1.0 - F.size(F.array_distinct(grams)) / F.greatest(F.size(grams), F.lit(1)))


def clauses(text: Column) -> Column:
    """Parts that end after a terminator; empty ones dropped."""
    return F.filter(F.split(text, f"(?<=[{SENTENCE_ENDS}])"), lambda part: part != "")


def segments(text: Column, least: int = 48, most: int = 420) -> Column:
    """Sentences packed greedily into segments of up to ``most`` characters; those under ``least`` are dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def flush(state):
        return F.when(F.length(state["held"]) >= least, F.array_append(state["done"], state["held"])).otherwise(state["done"])

    def step(state, piece):
        full = (state["held"] != "") & (F.length(state["held"]) + F.length(piece) > most)
        return F.struct(F.when(full, flush(state)).otherwise(state["done"]).alias("done"), F.when(full, piece).otherwise(F.concat(state["held"], piece)).alias("held"))

    pieces = F.filter(F.transform(clauses(text), strip), lambda p: p != "")
    return F.aggregate(pieces, start, step, flush)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def negation_marks(text: Column) -> Column:
    """Which of the markers occur, each once."""
    return F.filter(F.array(*map(F.lit, NEGATION_MARKS)), lambda mark: F.contains(text, mark))


def _common(expected: Column, actual: Column) -> Column:
    """Size of the multiset intersection."""
    def count(items, item):
        return F.size(F.filter(items, lambda x: x == item))

    return F.aggregate(F.array_distinct(expected), F.lit(0), lambda n, item: n + F.least(count(expected, item), count(actual, item)))


def multiset_recall(expected: Column, actual: Column) -> Column:
    """Share of expected items found; 1 if none are expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(_common(expected, actual) / F.size(expected))


def multiset_f1(expected: Column, actual: Column) -> Column:
    """Harmonic mean of precision and recall; 1 if both are empty."""
    return F.when((F.size(expected) == 0) & (F.size(actual) == 0), 1.0).otherwise(count_f1(_common(expected, actual), F.size(expected), F.size(actual)))


def count_f1(common: Column, expected: Column, actual: Column) -> Column:
    precision, recall = common / F.greatest(actual, F.lit(1)), common / F.greatest(expected, F.lit(1))
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))


def source_span(prompt: Column) -> Column:
    """The text between the two labels; raises where there is none."""
    found = strip(F.regexp_extract(prompt, SOURCE_SPAN, 1))
    return F.when(prompt.rlike(SOURCE_SPAN), found).otherwise(F.raise_error(F.lit("prompt has no source span")))


def asks_translation(text: Column) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(t)) for t in TRANSLATION_TERMS))


def translation_source(text: Column) -> Column:
    """What a request wants translated: its longest quotation, else its last line that is no request, else what follows the first colon."""
    quoted = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))
    longest = F.aggregate(quoted, F.lit(""), lambda best, q: F.when(F.length(q) > F.length(best), q).otherwise(best))
    plain = F.filter(lines_of(text), lambda line: ~asks_translation(line))
    after = strip(F.regexp_replace(text, "^[^\n]*?[:：]", ""))
    return F.when(F.size(quoted) > 0, strip(longest)).when(F.size(plain) > 0, F.element_at(plain, -1)).otherwise(truthy(after, strip(text)))


def route(requested: Column, last_user: Column, auto: str = "smart_repaired", translate: str = "translation_repaired", general: str = "official_instruct") -> Column:
    """The model that answers: the requested one unless it is ``auto``."""
    return F.when(requested != auto, requested).when(asks_translation(last_user), translate).otherwise(general)


#: Characters of both sides that are compared together.
CHRF_GROUP = 1 << 19
_STEP, _ROW = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _visible(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts without white space in a row, their text, how many follow in it (itself included), and sizes."""
    parts = ["".join(t.split()) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    rows = np.repeat(np.arange(len(parts)), sizes)
    return codes, rows, np.cumsum(sizes)[rows] - np.arange(len(codes)), sizes


def _counted(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their row, and how often each occurs."""
    found, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return found, rows[first], counts


def chrf_rows(hypotheses: list[str], references: list[str], order: int = 6, beta: float = 2.0) -> np.ndarray:
    """Sentence chrF (Popovic 2015) of many pairs: character n-grams without white space, averaged over the orders that both have.

    N-grams are rolling 64-bit hashes that hold their row, so the multisets of
    all pairs are counted and met by one sort for each side and order.
    """
    n_rows = len(hypotheses)
    sides = [_visible(hypotheses), _visible(references)]
    rolled = [np.zeros(len(s[0]), np.uint64) for s in sides]
    total_p, total_r, used = np.zeros(n_rows), np.zeros(n_rows), np.zeros(n_rows)
    for n in range(1, order + 1):
        counted = []
        for k, (codes, rows, left, _) in enumerate(sides):
            fits = np.flatnonzero(left >= n)
            rolled[k][fits] = rolled[k][fits] * np.uint64(_STEP) + codes[fits + (n - 1)]
            keys = rolled[k][fits] ^ (rows[fits].astype(np.uint64) + np.uint64(1)) * np.uint64(_ROW)
            keys ^= keys >> np.uint64(31)
            counted.append(_counted(keys * np.uint64(0xBF58476D1CE4E5B9), rows[fits]))
        (a, row, a_count), (b, _, b_count) = counted
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        both = np.bincount(row[i], np.minimum(a_count[i], b_count[j]), n_rows)
        h, r = (np.maximum(s[3] - n + 1, 0) for s in sides)
        has = (h > 0) & (r > 0)
        total_p += np.where(has, both / np.maximum(h, 1), 0)
        total_r += np.where(has, both / np.maximum(r, 1), 0)
        used += has
    p, q = total_p / np.maximum(used, 1), total_r / np.maximum(used, 1)
    return np.where(p + q > 0, 100 * (1 + beta**2) * p * q / np.where(p + q > 0, beta**2 * p + q, 1), 0.0)


def _chrf(hypothesis: str, reference: str) -> float:
    """chrF of one pair."""
    return float(chrf_rows([hypothesis], [reference])[0])


@F.pandas_udf(DoubleType())
def chrf(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """chrF of each pair, 0 to 100; nulls count as empty."""
    a, b = ([x or "" for x in side] for side in (hypothesis, reference))
    ends = np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)]) if a else np.zeros(0)
    out, lo = [], 0
    while lo < len(a):  # a bounded number of characters, one pair at least
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHRF_GROUP, side="right")))
        out.append(chrf_rows(a[lo:hi], b[lo:hi]))
        lo = hi
    return pd.Series(np.concatenate([np.zeros(0), *out]))
