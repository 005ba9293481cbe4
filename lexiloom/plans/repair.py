"""Capability repair and the diagnosis of training data, as stages of a runner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat, inference, review, sampling, sft, stats, tokens
from ..operators.acquire import column
from . import runner
from .corpus import SEED

# Rows of each split, examples a task, the step between diagnosed rows and the token limit.
LIMITS = {"train": 8192, "validation": 256, "test": 128}
EXAMPLES, STEP, LIMIT = 3, 20, 1024


@dataclass(frozen=True)
class Candidate:
    """A model under test: how it is loaded, whether it takes chat or plain prompts, and a name for its weights that changes when they do."""

    name: str
    loader: inference.Loader
    kind: str
    weights: str


@dataclass(frozen=True)
class Question:
    """A general question with terms that an answer must hold, all of them or any."""

    prompt: str
    expected: tuple[str, ...]
    every: bool = False


def repair_rows(df: DataFrame, order: str, seed: int | str = SEED, limits: dict[str, int] | None = None) -> DataFrame:
    """Exactly so many clean translation rows of each split, in hash order, with plain and chat prompts; raises when a split is short."""
    parts = []
    for split, n in (limits or LIMITS).items():
        own = sft.clean_translation(df.where(F.col("split") == split), order)
        parts.append(sampling.sample(own, n, seed, f"repair:{split}", "id").withColumn("split", F.lit(split)))
    rows = reduce(DataFrame.unionByName, parts)
    found = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    if short := {s: found.get(s, 0) for s, n in (limits or LIMITS).items() if found.get(s, 0) != n}:
        raise sampling.QuotaError(f"too few clean rows: {short}")
    asked = F.array(chat.message("user", F.col("source_text")), chat.message("assistant", F.col("answer_text")))
    return rows.withColumn("prompt_text", chat.plain_prompt("translation", F.col("source_text"))).withColumn("messages", asked)


def answered(candidate: Candidate, rows: DataFrame, text: str, layout: str) -> DataFrame:
    """``rows`` with the candidate's answers to a column of texts, prompted in its own layout."""
    plain = chat.plain_prompt(layout, F.col(text))
    prompt = plain if candidate.kind == "plain" else chat.render(F.array(chat.message("user", F.col(text))), header=True)
    return inference.generate(rows.withColumn("asked", prompt), "asked", candidate.loader, candidate.name).drop("asked")


def evaluate_translations(candidate: Candidate, test: DataFrame) -> DataFrame:
    """The candidate's translations of the test rows with their measures."""
    out = answered(candidate, test.select("id", F.col("source_text").alias("source"), F.col("answer_text").alias("reference")), "source", "translation")
    response = F.coalesce("response", F.lit(""))
    return out.withColumns({"replacement": F.contains(response, F.lit("�")), "repetition": T.repetition(response), "chrf": T.chrf(response, F.col("reference")), "model": F.lit(candidate.name)})


def evaluate_general(candidate: Candidate, asked: DataFrame) -> DataFrame:
    """The candidate's answers to ``prompt, expected, every``, and whether they pass."""
    out = answered(candidate, asked, "prompt", "question")
    plain = F.replace(F.lower(F.coalesce("response", F.lit(""))), F.lit(" "), F.lit(""))
    held = F.transform("expected", lambda t: F.contains(plain, F.replace(F.lower(t), F.lit(" "), F.lit(""))))
    passed = F.when(F.col("every"), F.forall(held, lambda x: x)).otherwise(F.exists(held, lambda x: x))
    return out.withColumns({"passed": passed, "model": F.lit(candidate.name)})


def summary(translations: DataFrame, general: DataFrame) -> DataFrame:
    """A row for each model: the rates that the gate asks for, and the share of general questions passed."""
    rows = stats.frozen_summary(translations, ["model"])
    passes = general.groupBy("model").agg(F.avg(F.col("passed").cast("double")).alias("general"))
    return rows.join(passes, "model").withColumnRenamed("model", "name")


def selection(summaries: DataFrame, baseline: str) -> DataFrame:
    """The best of the models that pass the capability gate against the baseline's general score; none if none does."""
    floor = summaries.where(F.col("name") == baseline).first()
    if floor is None:
        raise ValueError(f"{baseline} is not among the models")
    return stats.select_best(summaries, stats.capability_gate(floor["general"]))


def _evaluation(candidate: Candidate) -> list[runner.Stage]:
    settings = {"kind": candidate.kind, "weights": candidate.weights, "model": candidate.name}
    return [
        runner.Stage(f"translations-{candidate.name}", ("repair_rows",), lambda x, _: evaluate_translations(candidate, x["repair_rows"].where("split = 'test'")), settings, version="evaluate_translations 1"),
        runner.Stage(f"general-{candidate.name}", ("questions",), lambda x, _: evaluate_general(candidate, x["questions"]), settings, version="evaluate_general 1"),
        runner.Stage(f"summary-{candidate.name}", (f"translations-{candidate.name}", f"general-{candidate.name}"), lambda x, _: summary(*x.values()), {}, version="summary 1"),
    ]


def capability_repair(spark: SparkSession, folder: str, rows: DataFrame, order: str, candidates: list[Candidate], questions: list[Question], baseline: str, seed: int | str = SEED, limits: dict[str, int] | None = None) -> dict[str, runner.Result]:
    """Training rows, every candidate's evaluation, and the selection, each done once.

    Training itself happens elsewhere, from the ``repair_rows`` table; a
    candidate that was trained since gets a new ``weights`` name and only its
    own stages and the selection run again.  The last stage's gate fails where
    no model passes.
    """
    asked = spark.createDataFrame([(q.prompt, list(q.expected), q.every) for q in questions], "prompt string, expected array<string>, every boolean")
    chosen = limits or LIMITS
    stages = [runner.Stage("repair_rows", ("rows",), lambda x, s: repair_rows(x["rows"], s["order"], s["seed"], s["limits"]), {"order": order, "seed": seed, "limits": chosen}, version="repair_rows 1")]
    for c in candidates:
        stages += _evaluation(c)
    own = tuple(f"summary-{c.name}" for c in candidates)
    stages.append(runner.Stage("summaries", own, lambda x, _: reduce(DataFrame.unionByName, x.values()), {}, version="summaries 1"))
    stages.append(runner.Stage("selection", ("summaries",), lambda x, s: selection(x["summaries"], s["baseline"]), {"baseline": baseline}, _one_selected, version="selection 1"))
    return runner.run(spark, folder, {"rows": rows, "questions": asked}, stages)


def _one_selected(best: DataFrame) -> tuple[bool, dict]:
    row = best.first()
    name = row["name"] if row else None
    return name is not None, {"selected": name, "requires_human_review": True}


def evaluate_checkpoint(spark: SparkSession, folder: str, repaired: DataFrame, candidate: Candidate, questions: list[Question], known: DataFrame | None = None) -> DataFrame:
    """The summary row of a checkpoint that is there already, without training; a name that ``known`` summaries have raises."""
    if known is not None and not known.where(F.col("name") == candidate.name).isEmpty():
        raise ValueError(f"{candidate.name} has a result already")
    asked = spark.createDataFrame([(q.prompt, list(q.expected), q.every) for q in questions], "prompt string, expected array<string>, every boolean")
    return runner.run(spark, folder, {"repair_rows": repaired, "questions": asked}, _evaluation(candidate))[f"summary-{candidate.name}"].frame


# --- diagnosis ---------------------------------------------------------------------


def diagnosis(rows: DataFrame, order: str, encode: Callable = tokens.simple_tokens, end_mark: str = chat.END, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """``task`` (null: all), counters of what a training run would see, of every ``step``-th chat row in order.

    ``rows``: ``task, messages``.  A row counts if its prompt alone or the whole
    of it reaches the limit, if the whole does not begin with the prompt, if the
    answer is short, and if the end mark is within the limit of the answer.
    """
    prompt, _ = chat.prompt_and_completion(F.col("messages"))
    answer = chat.completion_text(F.col("messages"))
    taken = sampling.every_nth(rows.select(order, "task", "messages"), step, [order])
    coded = taken.select("task", encode(chat.render(prompt, header=True)).alias("prompt"), encode(chat.render(F.col("messages"))).alias("whole"), answer.alias("answer"))
    mark = encode(F.lit(end_mark))
    kept = F.slice(F.col("whole"), F.size("prompt") + 1, F.greatest(F.lit(limit) - F.size("prompt"), F.lit(0)))
    holds = F.exists(F.sequence(F.lit(1), F.greatest(F.size(kept) - F.size(mark) + 1, F.lit(1))), lambda i: F.slice(kept, i, F.size(mark)) == mark)
    counts = {
        "prompt_at_limit": F.size("prompt") >= limit,
        "over_limit": F.size("whole") > limit,
        "prefix_mismatch": F.slice(F.col("whole"), F.lit(1), F.size("prompt")) != F.col("prompt"),
        "short_answer": F.length("answer") < 10,
        "end_kept": holds,
    }
    flags = coded.select("task", *[c.cast("long").alias(n) for n, c in counts.items()])
    return flags.groupingSets([[], [F.col("task")]], "task").agg(F.grouping("task").alias("all_tasks"), F.count("*").alias("rows"), *[F.sum(n).alias(n) for n in counts])


def examples(rows: DataFrame, order: str, n: int = EXAMPLES, most: int = 500) -> DataFrame:
    """``task, number, provenance, prompt, answer`` of the first ``n`` rows of each task, texts cut for a report."""
    prompt = F.try_element_at(F.col("messages"), F.lit(-2))["content"]
    slim = rows.select(order, "task", column(rows, "provenance").alias("provenance"), F.substring(prompt, 1, most).alias("prompt"), F.substring(chat.completion_text(F.col("messages")), 1, most).alias("answer"))
    own = sampling.Window.partitionBy("task").orderBy(order)
    return slim.withColumn("number", F.row_number().over(own)).where(F.col("number") <= n).drop(order)


def training_data_diagnosis(spark: SparkSession, folder: str, rows: DataFrame, order: str, step: int = STEP, limit: int = LIMIT) -> dict[str, runner.Result]:
    """Counters by task and the first examples of each, each done once."""
    stages = [
        runner.Stage("counters", ("rows",), lambda x, s: diagnosis(x["rows"], order, limit=s["limit"], step=s["step"]), {"limit": limit, "step": step}, version="diagnosis 1"),
        runner.Stage("examples", ("rows",), lambda x, _: examples(x["rows"], order), {}, version="examples 1"),
    ]
    return runner.run(spark, folder, {"rows": rows}, stages)
