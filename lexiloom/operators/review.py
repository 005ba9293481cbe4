"""Generation scores, blinded review and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import keyed_hash

# Terminators and score range of the review.
LINE_ENDS = "[\n。！？]"
RUBRIC = (1, 5)
DIMENSIONS = {
    "old_to_modern": ("faithfulness", "completeness", "fluency"),
    "modern_to_old": ("meaning_preservation", "classical_style", "fluency"),
    "appreciation": ("factuality", "textual_evidence", "depth"),
    "creation": ("constraint_following", "style", "coherence", "originality"),
}


def constraint_score(response: Column, line_count: Column, keywords: Column) -> Column:
    """Mean of the checks that apply; null without constraints."""
    lines = F.size(F.filter(F.split(response, LINE_ENDS), T.nonblank))
    words = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda w: F.contains(response, w))
    checks = F.concat(F.when(line_count.isNotNull(), F.array(lines == line_count)).otherwise(F.array().cast("array<boolean>")), words)
    return F.when(F.size(checks) > 0, F.size(F.filter(checks, lambda c: c)) / F.size(checks))


def score_summary(scored: DataFrame, metrics: list[str], group: str = "task") -> DataFrame:
    """``task, metric, mean, n`` over the rows that have a metric."""
    long = scored.select(group, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select(group, "m.*")
    return long.groupBy(group, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def blind_id(seed: int | str, model: Column, question: Column) -> Column:
    return F.substring(keyed_hash(str(seed), model, question), 1, 16)


def blind(generations: DataFrame, seed: int | str, rubric: list[str] | dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """The sheet (no model, no order) and its key, from ``model, id, task, prompt, response, reference``.

    ``rubric``: what is scored, for all tasks or for each (other tasks get no scores).
    """
    rows = generations.withColumn("blind_id", blind_id(seed, F.col("model"), F.col("id")))
    fields = lambda names: F.create_map(*(x for r in names for x in (F.lit(r), F.lit(None).cast("int"))))
    empty = F.create_map().cast("map<string,int>") if isinstance(rubric, dict) else fields(rubric)
    for task, names in rubric.items() if isinstance(rubric, dict) else ():
        empty = F.when(F.col("task") == task, fields(names)).otherwise(empty)
    sheet = rows.select("blind_id", F.col("id").alias("question_id"), "task", "prompt", "response", "reference", empty.alias("scores"), F.lit("").alias("review_notes"))
    return sheet.orderBy(keyed_hash(str(seed), "sheet", F.col("blind_id"))), rows.select("blind_id", "model", F.col("id").alias("question_id"))


def review_summary(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """``model, task, mean, reviewed, incomplete`` with a row for each model over all tasks (task null).

    A row's score is the mean of its rubric; rows without all of it are
    incomplete, whatever they hold.  Unknown ids, and scores out of range in
    complete rows, raise.
    """
    if not sheet.join(key, "blind_id", "left_anti").isEmpty():
        raise KeyError("a reviewed row is not in the key")
    values = F.map_values("scores")
    done = F.coalesce((F.size(values) > 0) & ~F.exists(values, lambda v: v.isNull()), F.lit(False))
    wrong = F.exists(values, lambda v: ~v.between(*RUBRIC))
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    checked = F.when(done & F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("a score is out of range"))).when(done, mean)
    rows = sheet.join(key.select("blind_id", "model"), "blind_id").withColumn("score", checked)
    return rows.groupingSets([["model"], ["model", "task"]], "model", "task").agg(F.avg("score").alias("mean"), F.count("score").alias("reviewed"), F.count_if(F.col("score").isNull()).alias("incomplete"))


def knows(answer: Column, expected: list[str], every: bool = False) -> Column:
    """Does an answer (lower-cased, spaces dropped) hold any, or every, expected term?"""
    plain = F.replace(F.lower(answer), F.lit(" "), F.lit(""))
    terms = F.array(*(F.lit(e.lower().replace(" ", "")) for e in expected))
    return (F.forall if every else F.exists)(terms, lambda t: F.contains(plain, t))
