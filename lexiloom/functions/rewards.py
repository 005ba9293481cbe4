"""Reward functions over completions: Column builders in a registry, and their weighted mixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Bounds, markers, registry names and weights.
NONEMPTY = (8, 1200)
MODERN_MARKERS = "非常|这个|所以|因为|我们|总的来说"
EVIDENCE_MARKS = ("“", "「", "原文", "句")
COPY_FROM, COPY_SPAN = 70.0, 30.0
MIXES = {
    "drgrpo_reference_proxy": {"reference_chrf": 0.65, "nonempty": 0.10, "anti_repetition": 0.10, "reference_length": 0.15},
    "drgrpo_constraint_aware": {"reference_chrf": 0.35, "critical_token": 0.20, "source_copy_penalty": 0.15, "nonempty": 0.10, "anti_repetition": 0.10, "reference_length": 0.10},
    "drgrpo_reference_only": {"reference_chrf": 0.45, "critical_token": 0.20, "nonempty": 0.10, "anti_repetition": 0.15, "reference_length": 0.10},
    "drgrpo_calibrated_rm": {"reward_model": 0.30, "reference_chrf": 0.30, "critical_token": 0.15, "nonempty": 0.10, "anti_repetition": 0.10, "reference_length": 0.05},
}


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def nonempty(completion: Column, **_) -> Column:
    return F.when(F.length(T.strip(completion)).between(*NONEMPTY), 1.0).otherwise(-1.0)


def anti_repetition(completion: Column, **_) -> Column:
    return _clamp(2 * (1.0 - T.repetition(T.compact(completion))) - 1, -1.0, 1.0)


def task_constraint(completion: Column, task: Column, **_) -> Column:
    plain = F.when(completion.rlike(MODERN_MARKERS), -0.5).otherwise(0.5)
    evidence = F.when(completion.rlike("|".join(EVIDENCE_MARKS)), 0.5).otherwise(-0.25)
    return F.when(task.isin("modern_to_old", "creation"), plain).when(task == "appreciation", evidence).otherwise(0.0)


def reference_chrf(completion: Column, reference: Column, **_) -> Column:
    return _clamp(T.chrf(completion, reference) / 50 - 1, -1.0, 1.0)


def critical_token(completion: Column, source: Column, **_) -> Column:
    wanted, given = F.regexp_count(source, F.lit(T.SOURCE_NEGATIONS)), F.regexp_count(completion, F.lit(T.OUTPUT_NEGATIONS))
    negation = F.when((wanted == 0) & (given == 0), 1.0).otherwise(T.count_f1(F.least(wanted, given), wanted, given))
    return T.multiset_f1(T.numbers(source), T.numbers(completion)) + negation - 1


def source_copy_penalty(completion: Column, source: Column, **_) -> Column:
    return -_clamp((T.chrf(T.compact(completion), T.compact(source)) - COPY_FROM) / COPY_SPAN, 0.0, 1.0)


def reference_length(completion: Column, reference: Column, **_) -> Column:
    own, target = F.greatest(T.compact_length(completion), F.lit(1)), F.greatest(T.compact_length(reference), F.lit(1))
    return F.greatest(F.lit(-1.0), 1 - F.abs(F.log2(own / target)))


def reward_model(completion: Column, model_score: Column, **_) -> Column:
    """The score that a model gave, as a column."""
    return model_score


REGISTRY: dict[str, Callable[..., Column]] = {
    "nonempty": nonempty,
    "anti_repetition": anti_repetition,
    "task_constraint": task_constraint,
    "reference_chrf": reference_chrf,
    "critical_token": critical_token,
    "source_copy_penalty": source_copy_penalty,
    "reference_length": reference_length,
    "reward_model": reward_model,
}


def register(name: str, build: Callable[..., Column]) -> None:
    """Add a reward under a new name."""
    if name in REGISTRY:
        raise ValueError(f"reward {name} is registered already")
    REGISTRY[name] = build


def weighted(names: list[str], weights: list[float], **columns: Column) -> Column:
    """The weighted sum of registered rewards; unknown names, lengths that differ and missing columns raise."""
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"unknown rewards {unknown}")
    if len(names) != len(weights):
        raise ValueError(f"{len(names)} rewards and {len(weights)} weights")
    total = F.lit(0.0)
    for name, weight in zip(names, weights, strict=True):
        try:
            total = total + weight * REGISTRY[name](**columns)
        except TypeError as wrong:
            raise ValueError(f"reward {name} lacks a column: {wrong}") from wrong
    return total
