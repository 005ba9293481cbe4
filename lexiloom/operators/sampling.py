"""Deterministic sampling, quotas and mixtures.  Every order is a hash order; nothing depends on row placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash
from ..sources.shared import durable, unused

#: Partitions whose counts are broadcast.
MOST_PARTS = 100_000


class QuotaError(ValueError):
    """A quota cannot be met from the rows that may fill it."""


def hash_order(seed: int | str, namespace: str, key: Column) -> Column:
    """Sort key ``sha256(seed:namespace:key)``: the universal sampler."""
    return keyed_hash(str(seed), namespace, key)


def sample(df: DataFrame, n: int, seed: int | str, namespace: str, key: str) -> DataFrame:
    """The first ``n`` rows in hash order (top-k, no full sort)."""
    return df.orderBy(hash_order(seed, namespace, F.col(key)), key).limit(n)


def _ranked(df: DataFrame, groups: list[str], order: list[Column]) -> tuple[DataFrame, str]:
    """``df`` with its rank in its group, and that column's name."""
    (rank,) = unused(df.columns, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))), rank


def per_group(df: DataFrame, groups: list[str], limit: Column | int, seed: int | str, namespace: str, key: str) -> DataFrame:
    """Up to ``limit`` rows of each group in hash order; the filter on rank lets Spark cut groups before the shuffle."""
    ranked, rank = _ranked(df, groups, [hash_order(seed, namespace, F.col(key)), F.col(key)])
    return ranked.where(F.col(rank) <= limit).drop(rank)


def exact_quota(df: DataFrame, group: str, quotas: dict[str, int], seed: int | str, key: str, split: str = "split") -> DataFrame:
    """Exactly ``quotas[g]`` train rows of each group and up to ``max(1, round(5 %))`` of the other splits; raises when train is short."""
    train = {r[group]: r["count"] for r in df.where(F.col(split) == "train").where(F.col(group).isin(*quotas)).groupBy(group).count().collect()}  # a row a group
    if short := {g: train.get(g, 0) for g, n in quotas.items() if train.get(g, 0) < n}:
        raise QuotaError(f"too few train rows: {short}, wanted {quotas}")
    limit = F.lit(0)
    for g, n in quotas.items():
        aside = max(1, round(0.05 * n))
        limit = F.when(F.col(group) == g, F.when(F.col(split) == "train", n).otherwise(aside)).otherwise(limit)
    return per_group(df, [group, split], limit, seed, "quota", key)


def balanced(df: DataFrame, group: str, wanted: list[str], per: int, seed: int | str, key: str) -> DataFrame:
    """``per`` rows of each wanted group; raises when one is short."""
    found = {r[group]: r["count"] for r in df.where(F.col(group).isin(*wanted)).groupBy(group).count().collect()}
    if short := {g: found.get(g, 0) for g in wanted if found.get(g, 0) < per}:
        raise QuotaError(f"too few rows: {short}, wanted {per} each")
    return per_group(df.where(F.col(group).isin(*wanted)), [group], per, seed, "balanced", key)


def capped(df: DataFrame, group: str, wanted: list[str], cap: int, seed: int | str, key: str) -> DataFrame:
    """Up to ``cap`` rows of each wanted group; raises only when one has none."""
    found = {r[group] for r in df.where(F.col(group).isin(*wanted)).select(group).distinct().collect()}
    if missing := [g for g in wanted if g not in found]:
        raise QuotaError(f"no rows for {missing}")
    return per_group(df.where(F.col(group).isin(*wanted)), [group], cap, seed, "capped", key)


def difficulty(score: Column) -> Column:
    """``low`` under 20, ``medium`` under 40, else ``hard``."""
    return F.when(score < 20, "low").when(score < 40, "medium").otherwise("hard")


def stratified(df: DataFrame, band: str, limit: int, seed: int | str, key: str, shares: dict[str, float] | None = None) -> DataFrame:
    """``limit`` rows: 30 % low, 50 % medium, the rest hard; what a band lacks is filled from what is left over."""
    shares = shares or {"low": 0.3, "medium": 0.5}
    floors = {b: int(limit * s) for b, s in shares.items()}
    floors["hard"] = limit - sum(floors.values())
    target = F.coalesce(F.create_map(*(F.lit(x) for pair in floors.items() for x in pair))[F.col(band)], F.lit(0))
    order = [hash_order(seed, "band", F.col(key)), F.col(key)]
    ranked, rank = _ranked(df, [band], order)
    first = ranked.where(F.col(rank) <= target).drop(rank)
    taken = first.count()
    if taken >= limit:
        return first
    spare = ranked.where(F.col(rank) > target).drop(rank).orderBy(*order).limit(limit - taken)
    return first.unionByName(spare)


def match_bands(target: DataFrame, candidates: DataFrame, band: str, seed: int | str, key: str) -> DataFrame:
    """From each band as many candidates as the target has; raises when short."""
    need = {r[band]: r["count"] for r in target.groupBy(band).count().collect()}
    have = {r[band]: r["count"] for r in candidates.groupBy(band).count().collect()}
    if short := {b: have.get(b, 0) for b, n in need.items() if have.get(b, 0) < n}:
        raise QuotaError(f"too few controls: {short}, wanted {need}")
    limit = F.lit(0)
    for b, n in need.items():
        limit = F.when(F.col(band) == b, n).otherwise(limit)
    return per_group(candidates, [band], limit, seed, "match", key)


def every_nth(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Rows 0, n, 2n ... in the given order, numbered without gathering all rows in one task."""
    (at,) = unused(df.columns, "at")
    return number(df, order, at).where(F.col(at) % n == 0).drop(at)


def _shifted(counts: DataFrame, part: str) -> DataFrame:
    """``part, before`` of ``part, count``: rows in the parts ahead; a row a part."""
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))


def number(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """``df`` with ``out``: 0, 1, 2 ... in the given order; rows that tie are numbered in any order.

    A window without partitions would send every row to one task; instead rows
    are range-partitioned, numbered within a partition, and shifted by the
    counts of the partitions before (one row for each partition).
    """
    spark = df.sparkSession
    part, before = unused([*df.columns, out], "part", "before")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = durable(df.repartitionByRange(width, *order).withColumn(part, F.spark_partition_id()), "ranged")
    shifts = _shifted(ranged.groupBy(part).count(), part).withColumnRenamed("before", before)
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    met = ranged.join(F.broadcast(shifts) if width <= MOST_PARTS else shifts, part)
    return met.withColumn(out, (within - 1 + F.col(before)).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], out)


def ordinals(df: DataFrame, out: str = "ordinal") -> DataFrame:
    """``df`` with ``out``: 0, 1, 2 ... in the order of its partitions, without a shuffle.

    For scans: partition by partition as the source gives them, so the same
    files give the same numbers.
    """
    part, row, before = unused([*df.columns, out], "part", "row", "before")
    placed = df.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    shifts = _shifted(placed.groupBy(part).count(), part).withColumnRenamed("before", before)
    met = placed.join(F.broadcast(shifts) if df.rdd.getNumPartitions() <= MOST_PARTS else shifts, part)
    return met.withColumn(out, F.col(row) + F.col(before)).select(*[F.col(f"`{c}`") for c in df.columns], out)


def round_robin(df: DataFrame, names: list[str], order: list[str], out: str = "task") -> DataFrame:
    """Assign names in turn."""
    picks = F.array(*map(F.lit, names))
    (at,) = unused([*df.columns, out], "at")
    return number(df, order, at).withColumn(out, F.element_at(picks, (F.col(at) % len(names) + 1).cast("int"))).drop(at)


def argmin(df: DataFrame, metric: str, name: str) -> DataFrame:
    """Ranked candidates, best (least) first; raises where the metric is missing."""
    checked = F.when(F.col(metric).isNull(), F.raise_error(F.concat(F.lit("no metric for "), F.col(name)))).otherwise(F.col(metric))
    return df.withColumn(metric, checked).withColumn("rank", F.row_number().over(Window.orderBy(metric, name)))


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in the given order (top-k, no full sort)."""
    return df.orderBy(*order).limit(n)
