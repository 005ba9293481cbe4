"""Experiment data plans: negatives from model errors, ablation sets, pilots, validity audits."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import coin, keyed_hash, sha256_hex
from ..operators import judging, preferences, sampling, stats
from ..sources import artifacts
from ..sources.shared import durable, unused
from . import runner

# Limits of the sets and rules of the pilot.
TRAIN, VALIDATION = (768, 256), (128, 64)  # most and least confident pairs
REVIEWED = 50
PILOT_COUNTS = {"test": 16, "validation": 64, "train": 1024}
PILOT_BANNED = ("<|", "http", "答案：")
PILOT_PROVENANCE = "historytrans-bidirectional"


def repair_pairs(errors: DataFrame, limit: int, seed: int | str) -> tuple[DataFrame, DataFrame]:
    """Hard negatives from model errors (``id, chosen, rejected, rejected_chrf, source_copy_chrf, stopped, replacement, repetition``), and their report."""
    usable = errors.where(preferences.eligible(F.col("stopped"), F.col("replacement"), F.col("rejected"), F.col("chosen"), F.col("repetition"), F.col("rejected_chrf")))
    chosen = sampling.stratified(usable.withColumn("band", sampling.difficulty(F.col("rejected_chrf"))), "band", limit, seed, "id")
    counts = errors.agg(F.count("*").alias("candidates")).crossJoin(usable.agg(F.count("*").alias("eligible")))
    report = chosen.agg(F.count("*").alias("selected"), *(F.count_if(F.col("band") == b).alias(b) for b in ("low", "medium", "hard")), F.coalesce(F.avg("rejected_chrf"), F.lit(0.0)).alias("mean_rejected_chrf"), F.coalesce(F.avg("source_copy_chrf"), F.lit(0.0)).alias("mean_source_copy_chrf"))
    return chosen, counts.crossJoin(report)  # single rows


def ablation_sets(pairs: DataFrame, shown: DataFrame, judgments: DataFrame, seed: int | str, limits: dict[str, tuple[int, int]] | None = None) -> dict[str, DataFrame]:
    """High-confidence pairs, difficulty-matched controls, and the derived training rows, for each split.

    ``pairs``: id, source_id, split, prompt, chosen, rejected, rejected_chrf.
    Raises unless every pair is judged in both orders, the judge is consistent
    and each split has enough confident pairs.
    """
    limits = limits or {"train": TRAIN, "validation": VALIDATION}
    merged, _ = durable(judging.verdicts(judgments, shown), "verdicts")
    known = pairs.join(merged.select(F.col("pair_id").alias("id"), "high_confidence", "length_ratio"), "id", "left").withColumn("high_confidence", F.coalesce("high_confidence", F.lit(False))).withColumn("length_ratio", F.coalesce("length_ratio", F.lit(0.0))).withColumn("band", sampling.difficulty(F.col("rejected_chrf")))
    known, _ = durable(known, "known")
    found = {r["split"]: r["count"] for r in known.where("high_confidence").groupBy("split").count().collect()}
    stats.require_consistency(judging.merge_report(merged), pairs.count(), {s: (found.get(s, 0), least) for s, (_, least) in limits.items()})
    out = {}
    for split, (most, _) in limits.items():
        own = known.where(F.col("split") == split)
        high, _ = durable(sampling.sample(own.where("high_confidence"), most, seed, f"high:{split}", "id"), "high")
        rest = own.join(high.select("id"), "id", "left_anti").where(F.col("length_ratio").between(0.8, 1.25))
        out[f"high_confidence:{split}"] = high
        out[f"length_matched:{split}"] = sampling.match_bands(high, rest, "band", f"{seed}:control:{split}", "id")
        out[f"sft:{split}"] = high.select("id", "source_id", F.col("prompt").alias("prompt_text"), F.col("chosen").alias("answer_text"))
        out[f"grpo:{split}"] = high.select("id", "source_id", "prompt", T.source_span(F.col("prompt")).alias("source_text"), F.col("chosen").alias("reference"))
    chosen = reduce(DataFrame.unionByName, (out[f"high_confidence:{split}"] for split in limits))
    # the confident stratum is drawn from the pairs that were selected, the other from all that were judged otherwise
    strata = chosen.unionByName(known.where(~F.col("high_confidence")).join(merged.select(F.col("pair_id").alias("id")), "id", "left_semi"))
    out["review_sheet"], out["review_key"] = review_strata(strata, merged, seed)
    return out


def review_strata(known: DataFrame, merged: DataFrame, seed: int | str, each: int = REVIEWED) -> tuple[DataFrame, DataFrame]:
    """Up to ``each`` pairs of both strata with options in a hash order, and the key with the judge's verdict kept apart."""
    stratum = F.when(F.col("high_confidence"), "high_confidence").otherwise("ambiguous_or_reversed")
    rows = sampling.per_group(known.withColumn("stratum", stratum), ["stratum"], each, seed, "review", "id")
    rows = rows.withColumn("review_id", F.concat_ws(":", "stratum", "id"))
    first = coin(keyed_hash(str(seed), "side", F.col("id"))) == 0
    options = [F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("chosen", "rejected"), ("rejected", "chosen"))]
    empty = F.lit(None).cast("int")
    sheet = rows.select("review_id", "stratum", T.source_span(F.col("prompt")).alias("source"), options[0].alias("option_a"), options[1].alias("option_b"), F.lit("").alias("human_winner"), empty.alias("human_fidelity_a"), empty.alias("human_fidelity_b"), F.lit("").alias("notes"))
    judge = merged.select("pair_id", F.struct(*merged.columns).alias("judge"))
    key = rows.select("review_id", F.col("id").alias("pair_id"), F.when(first, "A").otherwise("B").alias("chosen_is")).join(judge, "pair_id", "left")
    return sheet.orderBy(keyed_hash(str(seed), "review-final", F.col("review_id"))), key


def pilot(rows: DataFrame, seed: int | str, tokens: str, counts: dict[str, int] | None = None) -> DataFrame:
    """A pilot of exactly so many clean translation rows of each split; contents and groups never cross splits.

    ``rows``: id, task, split, provenance, source_id, messages, and ``tokens``
    (their number).  Splits claim contents and groups in the order given.
    """
    counts = counts or PILOT_COUNTS
    answer, source = F.element_at("messages", -1)["content"], F.element_at("messages", -2)["content"]
    both = F.concat(source, answer)
    clean = (
        (F.col("task") == "old_to_modern") & (F.col("provenance") == PILOT_PROVENANCE) & F.length(answer).between(12, 180) & ~F.contains(both, F.lit("�")) & (F.col(tokens) <= 384)
        & ~F.exists(F.array(*map(F.lit, PILOT_BANNED)), lambda b: F.contains(both, b))
    )
    place = F.array_position(F.array(*map(F.lit, counts)), F.col("split"))
    key = sha256_hex(F.concat_ws("\x00", source, answer))
    content, group, at, order, rank = unused(rows.columns, "content", "group", "at", "order", "rank")
    kept = rows.where(F.size("messages") >= 2).where(clean & F.col("split").isin(*counts)).withColumn(content, key).withColumn(group, F.coalesce(T.truthy(F.col("source_id")), key)).withColumn(at, place).withColumn(order, sampling.hash_order(seed, "pilot", F.col("id")))
    for claim in (content, group):
        kept = kept.withColumn(rank, F.row_number().over(Window.partitionBy(claim).orderBy(at, order, "id"))).where(F.col(rank) == 1)
    limit = F.lit(0)
    for split, n in counts.items():
        limit = F.when(F.col("split") == split, n).otherwise(limit)
    out = sampling.per_group(kept, ["split"], limit, seed, "pilot", "id").drop(content, group, at, order, rank)
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    if short := {s: got.get(s, 0) for s, n in counts.items() if got.get(s, 0) != n}:
        raise sampling.QuotaError(f"pilot has {short}, wanted {counts}")
    return out


def intersection(outputs: dict[str, DataFrame], key: str, value: str, expected: int | None = None) -> DataFrame:
    """Rows that all outputs have, one column each; raises if there are not ``expected``."""
    met = None
    for name, df in outputs.items():
        own = df.select(key, F.col(value).alias(name))
        met = own if met is None else met.join(own, key)
    if expected is not None and met.count() != expected:
        raise stats.GateError(f"not {expected} rows in all outputs")
    return met


def validity_audit(expected: DataFrame, outputs: DataFrame, key: str, tasks: int, per_task: int) -> DataFrame:
    """``model, rows, distinct_responses`` of evaluation outputs (``model, key, task, response``).

    Raises unless every model answered exactly the expected questions, each
    task as often, and no response is empty.
    """
    if expected.count() != expected.select(key).distinct().count() or expected.count() != tasks * per_task:
        raise stats.GateError("the questions repeat or are not as many as they should be")
    models = outputs.select("model").distinct()
    wanted = models.crossJoin(expected.select(key))  # a few models
    if not wanted.join(outputs, ["model", key], "left_anti").isEmpty() or not outputs.join(expected, key, "left_anti").isEmpty():
        raise stats.GateError("a model's questions are not the expected ones")
    by_task = outputs.groupBy("model", "task").agg(F.count("*").alias("n"), F.count_if(~T.nonblank(F.col("response")) | F.col("response").isNull()).alias("blank"))
    if not by_task.where((F.col("n") != per_task) | (F.col("blank") > 0)).isEmpty():
        raise stats.GateError("a task is not complete")
    return outputs.groupBy("model").agg(F.count("*").alias("rows"), F.count_distinct("response").alias("distinct_responses"))


#: Settings that all runs of an ablation share, and those of each kind of stage.
RUN = {"use_qlora": True, "load_in_4bit": True, "max_steps": 64, "gradient_checkpointing": True, "logging_steps": 8, "eval_steps": 32, "save_steps": 32, "save_total_limit": 2, "warmup_steps": 4, "bf16": True, "resume_from_checkpoint": "auto"}
RUN_OF = {
    "sft": {"format_style": "plain", "max_seq_length": 512, "per_device_train_batch_size": 4, "per_device_eval_batch_size": 4, "gradient_accumulation_steps": 4},
    "dpo": {"max_length": 512, "loss_type": "sigmoid", "per_device_train_batch_size": 1, "per_device_eval_batch_size": 1, "gradient_accumulation_steps": 16},
}


def run_grid(variants: dict[str, dict], seeds: list[int], model: str, data: str, output: str) -> list[dict]:
    """A configuration for each variant and seed, with a name of both; ``variants``: ``stage, data`` and settings of their own, which count most."""
    out = []
    for name, variant in variants.items():
        if variant.get("stage") not in RUN_OF:
            raise ValueError(f"variant {name} has no stage of {sorted(RUN_OF)}")
        own = {k: v for k, v in variant.items() if k not in ("stage", "data")}
        reference = {"reference_model_name_or_path": model} if variant["stage"] == "dpo" else {}
        for seed in seeds:
            run = f"{name}-seed{seed}"
            paths = {"dataset_path": f"{data}/{variant['data']}/train.jsonl", "validation_path": f"{data}/{variant['data']}/validation.jsonl", "output_dir": f"{output}/{run}"}
            out.append({"name": run, "stage": variant["stage"], "seed": seed, "model_name_or_path": model, **paths, **RUN, **RUN_OF[variant["stage"]], **reference, **own})
    return out


def run_experiments(spark: SparkSession, folder: str, grid: list[dict], train: Callable[[dict], str], evaluate: Callable[[str, dict], DataFrame], gate: Column, questions: DataFrame) -> dict[str, runner.Result]:
    """Train (elsewhere, through ``train``, which gives the model's path) and evaluate every configuration once, sum up each, and select by the gate.

    ``evaluate(path, config)`` gives rows for ``stats.frozen_summary`` with
    ``general``.  A configuration that is complete is not run again; the last
    stage fails where none passes.
    """

    def one(config: dict) -> Callable[[dict, dict], DataFrame]:
        def run(_: dict, settings: dict) -> DataFrame:
            where = f"{folder.rstrip('/')}/{config['name']}"
            artifacts.save_run_metadata(spark, where, config, config["model_name_or_path"], "training")
            path = train(settings)
            rows, _ = durable(evaluate(path, settings), "evaluated")
            artifacts.save_run_metadata(spark, where, config, path, "complete", {"rows": rows.count()})
            return stats.frozen_summary(rows).crossJoin(rows.agg(F.avg("general").alias("general"))).withColumn("name", F.lit(config["name"]))  # single rows

        return run

    stages = [runner.Stage(c["name"], ("questions",), one(c), c, version="experiment 1") for c in grid]
    names = tuple(c["name"] for c in grid)
    chosen = lambda x, _: stats.select_best(reduce(DataFrame.unionByName, x.values()), gate)
    # the gate's expression is part of the code
    stages.append(runner.Stage("selected", names, chosen, {}, lambda df: (df.first()["name"] is not None, {"selected": df.first()["name"]}), version=f"select 1 {gate._jc.toString()}"))
    return runner.run(spark, folder, {"questions": questions}, stages)


def latest_checkpoint(names: list[str], prefix: str = "checkpoint-") -> str | None:
    """The name with the greatest numeric suffix; others do not count."""
    numbered = [(int(m[1]), n) for n in names if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", os.path.basename(n)))]
    return max(numbered)[1] if numbered else None


def is_complete(metadata: str | None, has_adapter: bool) -> bool:
    """A run whose metadata says complete and that left its adapter."""
    return bool(metadata) and has_adapter and json.loads(metadata).get("status") == "complete"


def copied_source_rows(rows: DataFrame, order: str, n: int = 16) -> DataFrame:
    """Smoke pairs: the first ``n`` rows in order with their source as the rejected answer."""
    return rows.orderBy(order).limit(n).select("id", F.col("prompt_text").alias("prompt"), F.col("answer_text").alias("chosen"), F.col("source_text").alias("rejected"))
