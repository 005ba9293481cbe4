"""Instruction data: pairs, validity, dedup, chat messages, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import bucket, sha256_hex
from ..sources.shared import unused
from .acquire import alias, column
from .chat import message
from .dedup import first_by
from .sampling import exact_quota

# Tasks and their length rules.
TASKS = ("old_to_modern", "modern_to_old", "appreciation", "creation")
RATIOS = {"appreciation": (0.02, 8.0), "modern_to_old": (0.12, 1.5)}
OTHER_RATIO, MIN_APPRECIATION = (0.12, 8.0), 6
#: Our own wording.
SYSTEM = "你熟悉中国古典文献，请依据给定内容作答。"
TEMPLATES = {
    "old_to_modern": ("把这段文言文译成现代汉语：\n", "用今天的话说明这段古文的意思：\n", "请给出下面古文的白话译文：\n"),
    "modern_to_old": ("把这段话写成文言：\n", "用文言表达下面的意思：\n", "请将下文改为文言：\n"),
    "appreciation": ("请赏析这段作品，并引原文为据：\n", "说明这段作品的内容与写法：\n", "解读下面的作品，不要编造背景：\n"),
    "creation": ("按下面的要求创作：\n", "依照题意写作：\n", "请完成这个写作任务：\n"),
}


def pair(df: DataFrame, task: Column) -> tuple[Column, Column]:
    """Source and target by the direction of the task."""
    c = lambda *names: F.coalesce(T.truthy(*(column(df, n) for n in names)), F.lit(""))
    source = F.when(task == "old_to_modern", c("classical", "input")).when(task == "modern_to_old", c("modern", "input")).otherwise(c("input", "prompt"))
    target = F.when(task == "old_to_modern", c("modern", "output")).when(task == "modern_to_old", c("classical", "output")).otherwise(c("output", "answer"))
    return source, target


def valid_pair(source: Column, target: Column, task: Column) -> Column:
    """Both sides have text and their lengths fit the task."""
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    fits = F.when(task == "appreciation", (F.length(target) >= MIN_APPRECIATION) & ratio.between(*RATIOS["appreciation"])).when(task == "modern_to_old", ratio.between(*RATIOS["modern_to_old"])).otherwise(ratio.between(*OTHER_RATIO))
    return T.nonblank(source) & T.nonblank(target) & fits


def chat_messages(source: Column, target: Column, task: Column, identity: Column, instruction: Column, templates: dict = TEMPLATES, system: str = SYSTEM) -> Column:
    """System, user and assistant turns; an instruction that is there already is not wrapped again.

    A template stands in front of the source, or around it where it has ``{text}``.
    """
    parts = {t: [x.partition("{text}") for x in own] for t, own in templates.items()}
    side = lambda k: F.create_map(*(x for t, own in parts.items() for x in (F.lit(t), F.array(*(F.lit(p[k]) for p in own)))))
    pick = F.lit(0)
    for t, own in parts.items():
        pick = F.when(task == t, bucket(identity, len(own))).otherwise(pick)
    wrapped = F.concat(F.get(side(0)[task], pick), source, F.get(side(2)[task], pick))
    user = F.when(F.coalesce(instruction, F.lit("")) != "", source).otherwise(wrapped)
    return F.array(message("system", F.lit(system)), message("user", user), message("assistant", target))


def candidates(df: DataFrame, order: str, entities: bool = True, templates: dict = TEMPLATES, system: str = SYSTEM, origin: str | None = None) -> DataFrame:
    """Valid pairs of the four tasks, first of equal ones, as chat rows.

    Without a source id the row's id stands for it, without a license
    ``unknown``, without a split ``train``; the provenance is the row's
    ``source``, or ``origin`` (where the rows were read) without one.
    """
    task = alias(column(df, "task"))
    source, target = pair(df, task)
    kind, asked, answer, identity = unused(df.columns, "kind", "asked", "answered", "identity")
    rows = df.withColumns({kind: task, asked: T.normalize_text(source, entities), answer: T.normalize_text(target, entities)})
    rows = rows.where(F.col(kind).isin(*TASKS) & valid_pair(F.col(asked), F.col(answer), F.col(kind)))
    rows = rows.withColumn(identity, sha256_hex(F.concat_ws("\x00", kind, asked, answer)))
    rows = first_by(rows, [identity], [F.col(order)])
    return rows.select(
        F.col(identity).alias("id"), F.col(kind).alias("task"), chat_messages(F.col(asked), F.col(answer), F.col(kind), F.col(identity), column(df, "instruction"), templates, system).alias("messages"),
        F.coalesce(T.truthy(column(df, "source_id")), column(df, "id")).alias("source_id"), column(df, "work").alias("work"), column(df, "author").alias("author"), F.coalesce(column(df, "license"), F.lit("unknown")).alias("license"),
        F.coalesce(column(df, "source"), F.lit(origin).cast("string")).alias("provenance"), F.coalesce(column(df, "split"), F.lit("train")).alias("split"),
    )


def build(df: DataFrame, order: str, seed: int | str, quotas: dict[str, int] | None = None, entities: bool = True, templates: dict = TEMPLATES, system: str = SYSTEM, origin: str | None = None) -> DataFrame:
    """Chat rows; with quotas exactly so many train rows of each task."""
    rows = candidates(df, order, entities, templates, system, origin)
    return rows if quotas is None else exact_quota(rows, "task", quotas, seed, "id")


#: Rules of the clean translation subset.
BANNED = ("http", "<|", "答案：", "作为ai", "无法回答", "translation:")


def clean_translation(df: DataFrame, order: str) -> DataFrame:
    """``id, task, source_id, source_text, answer_text``: strictly clean old-to-modern pairs, first of equal ones."""
    source, answer = (T.strip(F.coalesce(T.truthy(column(df, a), column(df, b)), F.lit(""))) for a, b in (("classical", "input"), ("modern", "output")))
    given, said, identity = unused(df.columns, "given", "said", "identity")
    rows = df.withColumn(given, source).withColumn(said, answer)
    both = F.concat(given, said)
    ratio = F.length(said) / F.length(given)
    clean = (
        (column(df, "task") == "old_to_modern") & F.length(given).between(8, 260) & F.length(said).between(10, 360) & ratio.between(0.55, 4.0)
        & (T.cjk_ratio(F.col(given), "visible") >= 0.55) & (T.cjk_ratio(F.col(said), "visible") >= 0.55)
        & ~F.exists(F.array(*map(F.lit, BANNED)), lambda b: F.contains(F.lower(both), b)) & ~T.has_run(both, 6)
    )
    rows = rows.where(clean).withColumn(identity, sha256_hex(F.concat_ws("\x00", given, said)))
    return first_by(rows, [identity], [F.col(order)]).select(F.col(identity).alias("id"), F.lit("old_to_modern").alias("task"), column(df, "source_id").alias("source_id"), F.col(given).alias("source_text"), F.col(said).alias("answer_text"))


def rl_prompts(rows: DataFrame, n: int, seed: int | str, split: str) -> DataFrame:
    """The first ``n`` rows in hash order as prompt-only rows with a reference for the reward; raises when short."""
    from .sampling import QuotaError, sample

    out = sample(rows, n, seed, split, "id").select("id", "source_id", "task", "source_text", F.concat(F.lit("原文："), F.col("source_text"), F.lit("\n译文：")).alias("prompt"), F.col("answer_text").alias("reference"))
    if out.count() != n:
        raise QuotaError(f"fewer than {n} rows for {split}")
    return out
