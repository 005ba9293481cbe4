"""Runs of a judge: prompts, resuming, parsing, written manifests, and the gate.

A run lives in a folder: ``answers`` is a journal (what finished tasks wrote
stays, whatever becomes of the run), ``manifest.json`` holds the state with the
digest of the input, ``report.json`` the report.  A folder belongs to one input,
model and protocol: another one raises, the same one goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import inference, judging, stats
from ..operators.acquire import column, shortened
from ..sources import artifacts, digest, journal
from ..sources.shared import exists, read_text, write_text

_ANSWERS = "response string, model_path string"


def prompts(shown: DataFrame, template: str = judging.PAIRWISE) -> DataFrame:
    """``shown`` with the text that the judge is asked (``source`` may be missing)."""
    return shown.withColumn("judge_prompt", judging.filled(template, source=column(shown, "source"), a=F.col("option_a"), b=F.col("option_b")))


def _run(spark: SparkSession, folder: str, protocol: str, settings: dict, inputs: DataFrame, tasks: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], schema: str, report: Callable[[DataFrame], tuple[bool, dict]], rows: int) -> dict:
    """Do what is left of ``tasks``, report on all answers, and write manifest and report; the manifest's facts."""
    where = f"{folder.rstrip('/')}/manifest.json"
    run = artifacts.Manifest({"protocol": protocol, **settings, "input": digest.table_digest(inputs)})
    if exists(spark, where) and (old := json.loads(read_text(spark, where))["input_sha256"]) != run.input_sha256:
        raise ValueError(f"{folder} holds a run of another input, model or protocol ({old})")
    run.save(spark, where).to("running").save(spark, where)
    path = f"{folder.rstrip('/')}/answers"
    try:
        fresh = journal.run_pending(tasks, path, key, ask, rows)
        passed, facts = report(journal.committed(spark, path, schema, key))
    except Exception as wrong:
        run.to("failed", error=shortened(str(wrong))).save(spark, where)
        raise
    write_text(spark, f"{folder.rstrip('/')}/report.json", json.dumps(facts, ensure_ascii=False, sort_keys=True))
    run.gate(passed, tasks=tasks.count(), answered=fresh, **facts).save(spark, where)
    return {"status": run.status, "input_sha256": run.input_sha256, **run.facts}


def _ask(loader: inference.Loader, model: str, keys: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    def ask(pending: DataFrame) -> DataFrame:
        answered = inference.generate(pending.select(*keys, "judge_prompt"), "judge_prompt", loader, model)
        return answered.select(*keys, "response", "model_path")

    return ask


def pairwise(spark: SparkSession, shown: DataFrame, output: str, loader: inference.Loader, model: str, least: float = stats.CONSISTENCY, rows: int = journal.ROWS) -> dict:
    """Judge both orders of every pair, and report on all of it.

    ``shown``: presentations.  ``output``: the run's folder.  The manifest
    completes if every pair has both orders and the judge agrees with itself
    often enough; answers that hold no judgment count as none.
    """

    def report(answers: DataFrame) -> tuple[bool, dict]:
        judgments = answers.select("presentation_id", judging.parse_pairwise(F.col("response")).alias("judge"))
        facts = judging.merge_report(judging.verdicts(judgments, shown)).first().asDict()
        facts |= {"pairs": shown.select("pair_id").distinct().count(), "unparsed": judgments.where("judge is null").count()}
        return facts["pairs_complete"] == facts["pairs"] and facts["position_consistency"] >= least, facts

    asked = prompts(shown)
    return _run(spark, output, "pairwise", {"model": model, "least": least}, asked, asked, "presentation_id", _ask(loader, model, ("presentation_id", "pair_id")), f"presentation_id string, pair_id string, {_ANSWERS}", report, rows)


def independent_tasks(pairs: DataFrame) -> DataFrame:
    """Scoring tasks of ``id, prompt, chosen, rejected`` with what the judge is asked: two protocols, each candidate by itself."""
    prompt = column(pairs, "prompt")
    source = F.when(prompt.rlike(T.SOURCE_SPAN), T.source_span(prompt)).otherwise(T.translation_source(prompt))
    each = judging.independent_tasks(pairs).join(pairs.select(F.col("id").cast("string").alias("pair_id"), source.alias("source")), "pair_id")
    texts = [judging.filled(t, source=F.col("source"), a=F.col("answer")) for t in judging.SINGLE_PROTOCOLS]
    return each.withColumn("judge_prompt", F.when(F.col("protocol") == 0, texts[0]).otherwise(texts[1]))


def independent_judgments(answers: DataFrame, pairs: DataFrame, shown: DataFrame, margin: float = judging.TIE_MARGIN) -> DataFrame:
    """``presentation_id, judge`` as a pairwise judge would give them: protocol ``n`` stands for order ``n``.

    The winner is the candidate with more utility; it is INVALID unless both
    candidates have scores in range.
    """
    scored = answers.select("pair_id", "protocol", "role", judging.parse_scores(F.col("response")).alias("scores"))
    wide = scored.groupBy("pair_id", "protocol").pivot("role", ["chosen", "rejected"]).agg(F.first("scores"))
    # every pair has a row for each protocol, answered or not
    asked = pairs.select(F.col("id").cast("string").alias("pair_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("protocol"))
    met = shown.join(asked, (shown["pair_id"] == asked["pair_id"]) & (F.col("order") == F.col("protocol"))).drop(asked["pair_id"]).join(wide, ["pair_id", "protocol"], "left")
    role = judging.compare(judging.utility(F.col("chosen")), judging.utility(F.col("rejected")), F.lit("chosen"), F.lit("rejected"), margin)
    winner = F.when(role == "tie", "TIE").when(role == F.col("option_a_role"), "A").when(role == F.col("option_b_role"), "B").otherwise("INVALID")
    both = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    side = lambda of: F.when(both, F.when(F.col(of) == "chosen", F.col("chosen")).otherwise(F.col("rejected")))
    return met.select("presentation_id", F.struct(winner.alias("winner"), side("option_a_role").alias("a"), side("option_b_role").alias("b"), F.concat(F.lit("protocol "), F.col("protocol").cast("string")).alias("reason")).alias("judge"))


def independent(spark: SparkSession, pairs: DataFrame, shown: DataFrame, output: str, loader: inference.Loader, model: str, margin: float = judging.TIE_MARGIN, least: float = stats.CONSISTENCY, rows: int = journal.ROWS) -> dict:
    """Score every candidate by itself under two protocols, and report as for a pairwise run; both protocols must agree often enough."""
    tasks = independent_tasks(pairs)

    def report(answers: DataFrame) -> tuple[bool, dict]:
        facts = judging.merge_report(judging.verdicts(independent_judgments(answers, pairs, shown, margin), shown)).first().asDict()
        facts |= {"pairs": pairs.count(), "unparsed": answers.where(judging.parse_scores(F.col("response")).isNull()).count()}
        return facts["position_consistency"] >= least, facts

    keys = ("task_id", "pair_id", "protocol", "role")
    return _run(spark, output, "independent", {"model": model, "least": least, "margin": margin}, tasks, tasks, "task_id", _ask(loader, model, keys), f"task_id string, pair_id string, protocol int, role string, {_ANSWERS}", report, rows)
