"""Preference pairs: hard negatives, splits, features, difficulty bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import bucket, keyed_hash, sha256_hex, stable_split
from . import chat
from .sampling import difficulty, sample

# Swaps, additions and cuts of the corruptions.
NEGATION_SWAPS = (("不", ""), ("未", "已"), ("无", "有"), ("莫", "皆"))
NUMERAL = "[一二三四五六七八九十百千万两0-9]+"
INTRUSION = "总的来说，这个结果非常不错。"
UNSUPPORTED = "作品语言优美，感情真挚，具有很高的艺术价值。"
CUT = 0.62


def _option(text: Column, label: str) -> Column:
    return F.struct(text.alias("text"), F.lit(label).alias("error"))


def corruptions(answer: Column, task: Column) -> Column:
    """All hard negatives that apply, each with its error label; a truncation if none does."""

    def first_replaced(old, new):
        at = F.instr(answer, old)
        return F.when(at > 0, _option(F.concat(F.substring(answer, F.lit(1), at - 1), F.lit(new), F.substring(answer, at + len(old), F.length(answer))), "wrong_negation"))

    number = F.regexp_extract(answer, NUMERAL, 0)
    at = F.instr(answer, number)
    replaced = F.concat(F.substring(answer, F.lit(1), at - 1), F.when(number == "三", "五").otherwise("三"), F.substring(answer, at + F.length(number), F.length(answer)))
    parts = T.clauses(answer)
    options = F.array_compact(
        F.array(
            *(first_replaced(a, b) for a, b in NEGATION_SWAPS),
            F.when(number != "", _option(replaced, "wrong_number")),
            F.when(F.size(parts) >= 2, _option(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ""), "omission")),
            F.when(task.isin("modern_to_old", "creation"), _option(F.concat(answer, F.lit(INTRUSION)), "modern_style_intrusion")),
            F.when(task == "appreciation", _option(F.lit(UNSUPPORTED), "unsupported_appreciation")),
        )
    )
    short = _option(F.concat(F.substring(answer, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(answer) * CUT).cast("int"))), F.lit("。")), "truncation")
    return F.when(F.size(options) > 0, options).otherwise(F.array(short))


def corrupt(answer: Column, task: Column, identity: Column) -> Column:
    """One corruption, chosen by a hash; a cut in half where nothing would change."""
    options = corruptions(answer, task)
    pick = F.get(options, bucket(identity, 1 << 30) % F.size(options))
    half = _option(F.concat(F.substring(answer, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(answer) / 2).cast("int"))), F.lit("。")), "truncation")
    return F.when(T.strip(pick["text"]) == T.strip(answer), half).otherwise(pick)


def build(rows: DataFrame, seed: int | str, limit: int | None = None) -> DataFrame:
    """Pairs from chat rows (``id, task, source_id, messages``, optionally ``rejected``): the last assistant turn against a given or made negative.

    The limit holds before rows without an answer are left out.
    """
    if limit is not None:
        rows = sample(rows, limit, seed, "preferences", "id")
    chosen = chat.last_of(F.col("messages"), "assistant")
    given = F.col("rejected").cast("string") if "rejected" in rows.columns else F.lit(None).cast("string")
    made = rows.withColumn("__chosen", chosen).where(T.nonblank(F.col("__chosen"))).withColumn("__bad", corrupt(F.col("__chosen"), F.col("task"), keyed_hash(str(seed), F.col("id"))))
    supplied = F.coalesce(given, F.lit("")) != ""
    rejected = F.when(supplied, given).otherwise(F.col("__bad.text"))
    error = F.when(supplied, "supplied").otherwise(F.col("__bad.error"))
    key = F.coalesce(T.truthy(F.col("source_id"), F.col("id")), F.lit(""))
    return made.withColumn("__r", rejected).select(
        sha256_hex(F.concat_ws("\x00", "id", "__chosen", "__r")).alias("id"), chat.without_answer(F.col("messages")).alias("prompt"), F.array(chat.message("assistant", F.col("__chosen"))).alias("chosen"),
        F.array(chat.message("assistant", F.col("__r"))).alias("rejected"), "task", "source_id", F.array(error).alias("error_types"), stable_split(key, seed, 0.80, 0.10).alias("split"),
    ).where("chosen <> rejected")


def error_counts(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode("error_types").alias("error")).groupBy("error").agg(F.count("*").alias("rows"))


def features(source: Column, chosen: Column, rejected: Column) -> Column:
    """Lengths, ratio, and how much of the source's numbers and negations each side keeps."""
    c, r = T.strip(chosen), T.strip(rejected)
    nums, negs = T.numbers(source), T.negation_marks(source)
    return F.struct(
        source.alias("source"), T.compact_length(c).alias("chosen_length"), T.compact_length(r).alias("rejected_length"), (T.compact_length(c) / F.greatest(T.compact_length(r), F.lit(1))).alias("length_ratio"),
        T.multiset_recall(nums, T.numbers(c)).alias("chosen_number_recall"), T.multiset_recall(nums, T.numbers(r)).alias("rejected_number_recall"),
        T.multiset_recall(negs, T.negation_marks(c)).alias("chosen_negation_recall"), T.multiset_recall(negs, T.negation_marks(r)).alias("rejected_negation_recall"),
        (F.size(nums) > 0).alias("has_number_constraint"), (F.size(negs) > 0).alias("has_negation_constraint"),
    )


def describe(value: Column, name: str) -> list[Column]:
    """Mean, median, 5th and 95th percentile (linear); zeros where there is nothing."""
    zero = lambda c, n: F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{name}_{n}")
    return [zero(F.avg(value), "mean"), zero(F.percentile(value, F.lit(0.5)), "median"), zero(F.percentile(value, F.lit(0.05)), "p05"), zero(F.percentile(value, F.lit(0.95)), "p95")]


def summarize(pairs: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Pair statistics from a column ``features`` in one aggregation."""
    f = lambda n: F.col(f"features.{n}")
    rate = lambda cond: F.coalesce(F.avg(cond.cast("double")), F.lit(0.0))
    c, r = f("chosen_length"), f("rejected_length")
    out = [
        F.count("*").alias("pairs"), *describe(c, "chosen_length"), *describe(r, "rejected_length"), rate(c > r).alias("chosen_longer_rate"), rate(c >= 1.5 * r).alias("chosen_1_5x_rate"), rate(r >= 1.5 * c).alias("rejected_1_5x_rate"),
        rate(f("length_ratio").between(0.8, 1.25)).alias("length_balanced_rate"), F.count_if(f("has_number_constraint")).alias("number_cases"), F.count_if(f("has_negation_constraint")).alias("negation_cases"),
    ]
    for kind in ("number", "negation"):
        for side in ("chosen", "rejected"):
            out += describe(F.when(f(f"has_{kind}_constraint"), f(f"{side}_{kind}_recall")), f"{side}_{kind}_recall")
    return pairs.groupBy(*(groups or [])).agg(*out)


def band_counts(pairs: DataFrame, score: str) -> DataFrame:
    return pairs.groupBy(difficulty(F.col(score)).alias("band")).agg(F.count("*").alias("rows"))


def eligible(stopped: Column, replacement: Column, response: Column, chosen: Column, repetition: Column, chrf: Column) -> Column:
    """Model errors that make usable negatives."""
    return stopped & ~replacement & T.nonblank(response) & (response != chosen) & (repetition <= 0.10) & chrf.between(3, 68)
