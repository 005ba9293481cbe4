"""Paired statistics, bootstrap intervals and acceptance gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import durable, unused
from . import sampling

# Ties, resamples and the thresholds of the gates.
TIE, SAMPLES = 1e-12, 10_000
CONSISTENCY, ACCURACY, LENGTH_CORRELATION = 0.70, 0.70, 0.35


class GateError(ValueError):
    """A quality gate failed."""


def paired(candidate: DataFrame, baseline: DataFrame, key: str, value: str, expected: int | None = None) -> DataFrame:
    """``key, delta`` of the rows in both; raises if there are not ``expected``."""
    own, other = unused([key], "own", "other")
    both = candidate.select(key, F.col(value).alias(own)).join(baseline.select(key, F.col(value).alias(other)), key).select(key, (F.col(own) - F.col(other)).alias("delta"))
    if expected is not None and both.count() != expected:
        raise GateError(f"not {expected} paired rows")
    return both


def win_tie_loss(deltas: DataFrame, groups: list[str] | None = None) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy(*(groups or [])).agg(F.avg(d).alias("mean_delta"), F.count_if(d > TIE).alias("wins"), F.count_if(F.abs(d) <= TIE).alias("ties"), F.count_if(d < -TIE).alias("losses"))


#: Values that a task of the bootstrap holds and draws from.
LEAF = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: 64 random bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def leaf_draws(n: int, leaf: int, size: int, seed: int, samples: int) -> np.ndarray:
    """How many of its ``n`` draws each resample takes from the leaf with places ``leaf * size`` and on.

    Draws are split down a binary tree over the leaves: how many of a node's
    draws go to its left half is binomial in the half's share of the node's
    rows, seeded by the node.  So counts over all leaves are multinomial and add
    up to ``n``, and each leaf finds its own without knowing any other.
    """
    lo, hi = 0, -(-n // size)
    draws = np.full(samples, n, dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        share = (mid - lo) * size / (min(hi * size, n) - lo * size)
        left = np.random.Generator(np.random.PCG64([seed % (1 << 64), lo, hi])).binomial(draws, share)
        lo, hi, draws = (lo, mid, left) if leaf < mid else (mid, hi, draws - left)
    return draws


def bootstrap_ci(deltas: DataFrame, key: str, seed: int, samples: int = SAMPLES, leaf_size: int = LEAF) -> DataFrame:
    """Percentile bootstrap of the mean: ``mean, low, high`` (2.5 and 97.5 %).

    Each resample draws as many values as there are rows, with replacement.
    Values stand in order of the key and are cut in leaves of ``leaf_size``
    places; :func:`leaf_draws` says how many draws a leaf gets, and draw ``j`` of
    resample ``r`` in a leaf takes the place splitmix64(seed + r n + j + leaf
    golden) modulo the leaf's size.  A task holds one leaf, nothing is broadcast,
    and neither partitions nor tasks change the result.  Null deltas do not
    count; no deltas give nulls.
    """
    spark = deltas.sparkSession
    own = deltas.where(F.col("delta").isNotNull()).select(F.col(key).cast("string").alias("key"), F.col("delta").cast("double").alias("delta"))
    placed, _ = durable(sampling.number(own, ["key", "delta"], "place"), "placed")
    n = placed.count()
    mean = deltas.agg(F.avg("delta").alias("mean"))
    if not n:
        return mean.select("mean", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    leaves = -(-n // leaf_size)
    # few leaves: several tasks each, for different resamples
    turns = max(1, min(samples, 4 * spark.sparkContext.defaultParallelism // leaves))

    def drawn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, turn = map(int, key)
        values = pdf.sort_values("place")["delta"].to_numpy()
        counts = leaf_draws(n, leaf, leaf_size, seed, samples)
        out = []
        for r in range(turn, samples, turns):
            total, base = 0.0, seed + r * n + leaf * 0x9E3779B97F4A7C15
            for at in range(0, int(counts[r]), 1 << 20):
                draw = np.arange(at, min(int(counts[r]), at + (1 << 20)), dtype=np.uint64) + np.uint64(base % (1 << 64))
                total += values[(_mixed(draw) % np.uint64(len(values))).astype(np.int64)].sum()
            out.append((r, total))
        return pd.DataFrame(out, columns=["resample", "total"])

    dealt = placed.select(F.expr(f"place div {leaf_size}").alias("leaf"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "place", "delta")
    totals = dealt.groupBy("leaf", "turn").applyInPandas(drawn, "resample long, total double")
    means = totals.groupBy("resample").agg((F.sum("total") / n).alias("mean"))
    low_high = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return mean.crossJoin(low_high)  # two single rows


def seeds(values: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and sample deviation (0 for one value) over runs."""
    return values.groupBy(group).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.count("*").alias("runs"))


def frozen_summary(rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Rates and means of a frozen evaluation: ``response, source, stopped, replacement, repetition, chrf, tokens``."""
    rate = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*(groups or [])).agg(F.count("*").alias("rows"), rate(F.col("stopped")).alias("stop_rate"), rate(F.col("replacement")).alias("replacement_rate"), F.avg("repetition").alias("repetition"), F.avg("chrf").alias("chrf"), F.avg("tokens").alias("tokens"), rate(T.compact(F.col("response")) == T.compact(F.col("source"))).alias("exact_copy_rate"))


def capability_gate(baseline_general: float) -> Column:
    return (F.col("stop_rate") >= 0.95) & (F.col("replacement_rate") == 0) & (F.col("repetition") <= 0.10) & (F.col("general") >= baseline_general - 0.10)


def dpo_gate(chrf: float, general: float) -> Column:
    return (F.col("stop_rate") == 1) & (F.col("replacement_rate") == 0) & (F.col("repetition") <= 0.01) & (F.col("chrf") >= chrf) & (F.col("general") >= general - 0.05)


def grpo_gate(chrf: float, general: float) -> Column:
    return (F.col("chrf") >= chrf) & (F.col("stop_rate") == 1) & (F.col("replacement_rate") == 0) & (F.col("repetition") <= 0.005) & (F.col("general") >= general)


def select_best(models: DataFrame, gate: Column) -> DataFrame:
    """Of the models that pass, the greatest by chrF, general score, name."""
    return models.where(gate).agg(F.max(F.struct("chrf", "general", "name")).alias("best")).select("best.*")


def calibration(rows: DataFrame, margin: str, length_gap: str) -> DataFrame:
    """Accuracy of positive margins and their correlation with the length gap (0 up to two rows)."""
    out = rows.agg(F.count("*").alias("rows"), F.avg((F.col(margin) > 0).cast("double")).alias("accuracy"), F.corr(margin, length_gap).alias("__r"))
    r = F.when(F.col("rows") <= 2, 0.0).otherwise(F.coalesce(F.nanvl("__r", F.lit(0.0)), F.lit(0.0)))
    return out.withColumn("length_correlation", r).drop("__r").withColumn("passed", (F.col("accuracy") >= ACCURACY) & (F.abs("length_correlation") <= LENGTH_CORRELATION))


def require_consistency(report: DataFrame, pairs: int, confident: dict[str, tuple[int, int]]) -> None:
    """Raise unless all pairs are judged twice, consistency holds, and each split has enough confident pairs."""
    row = report.first()
    if row["pairs_complete"] != pairs:
        raise GateError(f"{row['pairs_complete']} of {pairs} pairs are judged in both orders")
    if row["position_consistency"] < CONSISTENCY:
        raise GateError(f"position consistency {row['position_consistency']:.3f} is under {CONSISTENCY}")
    if short := {k: v for k, v in confident.items() if v[0] < v[1]}:
        raise GateError(f"too few confident pairs (found, wanted): {short}")


def preference_accuracy(chosen: Column, rejected: Column) -> Column:
    return F.avg((chosen > rejected).cast("double"))
