"""Position-swapped judging: presentations, verdicts, utilities, bias reports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import coin, keyed_hash

# Rubric ranges, weights, margins and score layout.
WEIGHTS = {"faithfulness": 4, "completeness": 2, "fluency": 1, "hallucination": -4}
RANGES = {"faithfulness": 4, "completeness": 4, "fluency": 2, "hallucination": 2}
TIE_MARGIN = 1.0
SCORES = "struct<faithfulness:double,completeness:double,fluency:double,hallucination:double>"
JUDGE = f"struct<winner:string,a:{SCORES},b:{SCORES},reason:string>"


def presentations(pairs: DataFrame, seed: int | str) -> DataFrame:
    """Two rows for each pair (``id, split, source_id, chosen, rejected``): both orders, the first by a hash coin."""
    both = pairs.withColumn("order", F.explode(F.array(F.lit(0), F.lit(1))))
    pick = lambda x, y: F.when((coin(keyed_hash(str(seed), F.col("id"))) == 0) == (F.col("order") == 0), x).otherwise(y)
    return both.select(
        F.concat_ws(":", "split", "id", F.col("order").cast("string")).alias("presentation_id"), F.col("id").cast("string").alias("pair_id"), "split", "order", "source_id",
        pick(F.col("chosen"), F.col("rejected")).alias("option_a"), pick(F.col("rejected"), F.col("chosen")).alias("option_b"), pick(F.lit("chosen"), F.lit("rejected")).alias("option_a_role"), pick(F.lit("rejected"), F.lit("chosen")).alias("option_b_role"),
        *([F.col("features")] if "features" in pairs.columns else []),
    )


def parse_pairwise(raw: Column) -> Column:
    """The outermost braces of an answer as a judgment; null where they hold no object."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), JUDGE)


def parse_scores(raw: Column) -> Column:
    """The first braces of an answer as scores; null unless all are there and in range."""
    found = F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*?\}", 0), F.lit("")), SCORES)
    return F.when(utility(found).isNotNull(), found)


def normalize_winner(winner: Column, a_role: Column, b_role: Column) -> Column:
    """A or B as its role, TIE as tie, anything else invalid."""
    said = F.upper(F.trim(F.coalesce(winner, F.lit(""))))
    return F.when(said == "A", a_role).when(said == "B", b_role).when(said == "TIE", "tie").otherwise("invalid")


def utility(scores: Column) -> Column:
    """4 faithfulness + 2 completeness + fluency - 4 hallucination; null if any is missing or out of range."""
    fits, total = F.lit(True), F.lit(0.0)
    for name, weight in WEIGHTS.items():
        fits = fits & F.coalesce(scores[name].between(0, RANGES[name]), F.lit(False))
        total = total + weight * scores[name].cast("double")
    return F.when(fits, total)


def compare(a: Column, b: Column, a_name: Column, b_name: Column, margin: float = TIE_MARGIN) -> Column:
    """The better of two utilities, a tie within the margin, invalid if either is null."""
    return F.when(a.isNull() | b.isNull(), "invalid").when(F.abs(a - b) <= margin, "tie").when(a > b, a_name).otherwise(b_name)


def score_winner(judge: Column) -> Column:
    """A, B or TIE by the judge's own scores, whatever their range; INVALID if one is missing."""
    total = lambda s: sum((w * judge[s][n] for n, w in WEIGHTS.items()), F.lit(0.0))
    a, b = total("a"), total("b")
    return F.when(a.isNull() | b.isNull(), "INVALID").when(F.abs(a - b) <= TIE_MARGIN, "TIE").when(a > b, "A").otherwise("B")


def verdicts(judgments: DataFrame, shown: DataFrame) -> DataFrame:
    """One row for each pair judged in both orders: roles that won, consistency, high confidence.

    ``judgments``: presentation_id, judge (struct).  Unmatched or empty ones are left out.
    """
    met = judgments.where("judge is not null").select("presentation_id", "judge").join(shown, "presentation_id")
    role = lambda want, name: F.coalesce(F.when(F.col("option_a_role") == want, F.col(f"judge.a.{name}")).otherwise(F.col(f"judge.b.{name}")).cast("double"), F.lit(-1.0))
    rows = met.select(
        "pair_id", "split", "source_id", "order", normalize_winner(F.col("judge.winner"), F.col("option_a_role"), F.col("option_b_role")).alias("w"), role("chosen", "faithfulness").alias("cf"), role("rejected", "faithfulness").alias("rf"),
        role("chosen", "hallucination").alias("ch"), role("rejected", "hallucination").alias("rh"), *([F.col("features.length_ratio").alias("ratio")] if "features" in shown.columns else [F.lit(1.0).alias("ratio")]),
    )
    # a pair has two orders, so the lists are short
    by = rows.groupBy("pair_id").agg(F.first("split").alias("split"), F.first("source_id").alias("source_id"), F.sort_array(F.collect_list(F.struct("order", "w", "cf", "rf", "ch", "rh"))).alias("j"), F.max("ratio").alias("length_ratio")).where("size(j) = 2")
    both = lambda x: (F.col("j")[0]["w"] == x) & (F.col("j")[1]["w"] == x)
    confident = both("chosen") & (F.array_min("j.cf") >= F.array_max("j.rf") + 1) & (F.array_max("j.ch") <= F.array_min("j.rh")) & F.col("length_ratio").between(0.8, 1.25)
    return by.select(
        "pair_id", "split", "source_id", F.col("j.w").alias("winner_roles"), (F.col("j")[0]["w"] == F.col("j")[1]["w"]).alias("position_consistent"), F.col("j.cf").alias("chosen_faithfulness"), F.col("j.rf").alias("rejected_faithfulness"),
        F.col("j.ch").alias("chosen_hallucination"), F.col("j.rh").alias("rejected_hallucination"), confident.alias("high_confidence"), "length_ratio",
    )


def merge_report(merged: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Pairs, consistency and double-win rates (equal invalid or tied roles count as consistent), confident pairs."""
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    double = lambda role: F.col("position_consistent") & (F.col("winner_roles")[0] == role)
    return merged.groupBy(*(groups or [])).agg(F.count("*").alias("pairs_complete"), rate(F.col("position_consistent")).alias("position_consistency"), rate(double("chosen")).alias("double_chosen_rate"), rate(double("rejected")).alias("double_rejected_rate"), F.count_if("high_confidence").alias("high_confidence"))


def outcomes(merged: DataFrame) -> DataFrame:
    """Histogram of joined roles, or ``inconsistent``."""
    return merged.groupBy(F.when(F.col("position_consistent"), F.array_join("winner_roles", "/")).otherwise("inconsistent").alias("outcome")).agg(F.count("*").alias("pairs"))


def position_bias(judgments: DataFrame, shown: DataFrame, examples: int = 20) -> dict[str, DataFrame]:
    """What the order of the options did: winners and roles by order, patterns over both orders, by the judge's word and by its scores, and schema counts.

    A judgment of nothing shown raises.  A missing winner is INVALID, which is
    no schema violation; one of its own making is, and so is a score that is
    not there.  Patterns come most common first; ``examples`` are the first
    pairs, in order of their ids, whose roles differ between the orders.
    """
    missing = judgments.join(shown, "presentation_id", "left_anti")
    if not missing.isEmpty():
        raise KeyError("a judgment has no presentation")
    met = judgments.join(shown, "presentation_id")
    winner = F.upper(T.strip(F.coalesce(F.col("judge.winner"), F.lit("INVALID"))))
    role = lambda said: normalize_winner(said, F.col("option_a_role"), F.col("option_b_role"))
    reason = T.strip(F.coalesce(F.col("judge.reason"), F.lit("")))
    rows = met.select("pair_id", "order", winner.alias("winner"), role(F.col("judge.winner")).alias("role"), score_winner(F.col("judge")).alias("by_score"), role(score_winner(F.col("judge"))).alias("score_role"), reason.alias("reason"), "judge")
    bad_winner = ~F.col("winner").isin("A", "B", "TIE", "INVALID")
    bad_scores = reduce(lambda x, y: x | y, (F.col(f"judge.{s}.{n}").isNull() for s in "ab" for n in WEIGHTS))
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))

    def patterns(name: str, absent: str) -> DataFrame:
        wide = rows.groupBy("pair_id").pivot("order", [0, 1]).agg(F.first(name))
        found = wide.groupBy(F.concat_ws("/", F.coalesce("0", F.lit(absent)), F.coalesce("1", F.lit(absent))).alias("pattern")).agg(F.count("*").alias("pairs"))
        return found.orderBy(F.desc("pairs"), "pattern")  # a few patterns

    both = rows.groupBy("pair_id").pivot("order", [0, 1]).agg(F.first("score_role").alias("s"), F.first("role").alias("r"), F.first("reason").alias("why"))
    complete = both.where(F.col("0_s").isNotNull() & F.col("1_s").isNotNull())
    differ = complete.where(F.col("0_r") != F.col("1_r")).select("pair_id", F.array("0_r", "1_r").alias("winner_roles"), F.array("0_why", "1_why").alias("reasons"))
    return {
        "winners": rows.groupBy("winner").agg(F.count("*").alias("rows")),
        "winners_by_order": rows.groupBy("order", "winner").agg(F.count("*").alias("rows")),
        "roles": rows.groupBy("role").agg(F.count("*").alias("rows")),
        "roles_by_order": rows.groupBy("order", "role").agg(F.count("*").alias("rows")),
        "patterns": patterns("role", "MISSING"),
        "pair_patterns": patterns("winner", "MISSING"),
        "score_patterns": patterns("score_role", "missing"),
        "score_consistency": complete.agg(F.count("*").alias("pairs"), rate(F.col("0_s") == F.col("1_s")).alias("position_consistency")),
        "examples": differ.orderBy("pair_id").limit(examples),
        "schema": rows.agg(F.count("*").alias("rows"), rate(F.col("judge").isNull()).alias("parse_error_rate"), rate(F.col("reason") == "").alias("missing_reason_rate"), (F.count_if(bad_winner) + F.count_if(bad_scores)).alias("schema_violations"), F.count_if(F.contains(F.upper("reason"), F.lit("C"))).alias("spurious_c"), rate(F.col("winner") == F.col("by_score")).alias("score_agreement")),
    }


#: Our own wording of what a judge is asked.
PAIRWISE = "你是严格的评审。比较两份译文，只依据原文打分。\n原文：\n{source}\n\n译文A：\n{a}\n\n译文B：\n{b}\n\n只输出一个JSON对象：winner为A、B或TIE；a与b各含faithfulness(0-4)、completeness(0-4)、fluency(0-2)、hallucination(0-2)；reason为一句理由。"
SINGLE = "你是严格的评审。只依据原文给译文打分。\n原文：\n{source}\n\n译文：\n{a}\n\n只输出一个JSON对象，含faithfulness(0-4)、completeness(0-4)、fluency(0-2)、hallucination(0-2)。"

#: The two protocols of independent scoring: the same rubric, asked in two ways.
SINGLE_PROTOCOLS = (SINGLE, "逐句核对译文与原文，先找错译、漏译与臆增，再打分。\n原文：\n{source}\n\n待评译文：\n{a}\n\n只输出一个JSON对象：faithfulness(0-4)为忠实，completeness(0-4)为完整，fluency(0-2)为通顺，hallucination(0-2)为臆增。")


def filled(template: str, **values: Column) -> Column:
    """A template with its ``{names}`` replaced by columns; their texts are taken as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce(values[p], F.lit("")) for k, p in enumerate(parts)))


def independent_tasks(pairs: DataFrame) -> DataFrame:
    """Four scoring tasks for each pair: two protocols times two roles."""
    each = pairs.withColumn("protocol", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("role", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    return each.select(F.concat_ws(":", F.col("id").cast("string"), F.col("protocol").cast("string"), "role").alias("task_id"), F.col("id").cast("string").alias("pair_id"), "protocol", "role", F.when(F.col("role") == "chosen", F.col("chosen")).otherwise(F.col("rejected")).alias("answer"))


def independent_winners(scored: DataFrame) -> DataFrame:
    """``pair_id, protocol, winner`` from scores of both roles (``pair_id, protocol, role, scores``)."""
    wide = scored.withColumn("u", utility(F.col("scores"))).groupBy("pair_id", "protocol").pivot("role", ["chosen", "rejected"]).agg(F.first("u"))
    return wide.select("pair_id", "protocol", compare(F.col("chosen"), F.col("rejected"), F.lit("chosen"), F.lit("rejected")).alias("winner"))


def pending(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks without a result: what a restart still has to do."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")
