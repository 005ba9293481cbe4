"""Passages and rules for answers that a teacher model writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .sampling import round_robin, sample

# Gates and tasks.
MIN_CJK, MIN_ANSWER, MAX_ANSWER, EVIDENCE, COPIED = 0.65, 24, 1600, 4, 8
TASKS = ("appreciation", "creation")
#: Our own wording.
QUESTIONS = {"appreciation": "请翻译下文并赏析，每个论点都引原文为据：\n", "creation": "取下文的意象另作一段文言短文，不要照抄：\n"}


def is_classical(category: Column, text: Column) -> Column:
    return F.coalesce(F.lower(category) == "classical", F.lit(False)) & (T.cjk_ratio(text, "all") >= MIN_CJK)


def passages(df: DataFrame, key: str, limit: int, seed: int | str, entities: bool = True) -> DataFrame:
    """``passage_id, passage, task, prompt``: segments of classical sources, sampled, with tasks in turn."""
    kept = df.where(is_classical(F.col("category"), F.col("text"))).select(F.col(key).cast("string").alias("source_id"), F.posexplode(T.segments(T.normalize_text(F.col("text"), entities))).alias("n", "passage"))
    chosen = sample(kept.withColumn("passage_id", F.concat_ws(":", "source_id", F.col("n").cast("string"))), limit, seed, "teacher", "passage_id")
    return round_robin(chosen.drop("n"), list(TASKS), ["passage_id"]).withColumn("prompt", F.concat(task_question(F.col("task")), F.col("passage")))


def task_question(task: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in QUESTIONS.items() for x in pair))
    return F.coalesce(known[task], F.raise_error(F.concat(F.lit("no such teacher task: "), F.coalesce(task, F.lit("null")))))


def shares_span(answer: Column, passage: Column, size: int, across_lines: bool) -> Column:
    """Does the answer hold any run of ``size`` characters of the passage?"""
    spans = T.ngrams(passage, size)
    return F.exists(spans, lambda s: F.contains(answer, s) if across_lines else F.contains(answer, s) & ~F.contains(s, F.lit("\n")))


def rejections(task: Column, answer: Column, passage: Column) -> Column:
    """Reasons to reject an answer; empty if it passes."""
    return F.array_compact(
        F.array(
            F.when(F.length(T.strip(answer)) < MIN_ANSWER, "answer_too_short"),
            F.when(F.length(answer) > MAX_ANSWER, "answer_too_long"),
            F.when((task == "appreciation") & ~shares_span(answer, passage, EVIDENCE, False), "no_textual_overlap"),
            F.when((task == "creation") & shares_span(answer, passage, COPIED, True), "copied_eight_char_span"),
        )
    )
