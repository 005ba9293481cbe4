"""A look-up join that holds for skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import unused

#: A key is hot if it holds more than this part of the rows of a mean shuffle partition; so there are at most SPREAD of them a partition.
SPREAD = 4


def lookup(rows: DataFrame, table: DataFrame, key: str, frequent: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has each ``key`` once.

    Keys that many rows share are taken from a broadcast of the few hot rows of
    ``table``, at most ``SPREAD`` for each shuffle partition; all others are
    joined by a shuffle in which no key is large.  ``frequent`` gives ``key,
    n``, how many rows have it, where that is known.  Null keys find nothing and
    are not shuffled.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = frequent if frequent is not None else rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where(F.col("n") > max(1, total // (SPREAD * width))).select(key)
    is_hot, found = unused([*rows.columns, *table.columns], "is_hot", "found")
    marked = rows.join(F.broadcast(hot.withColumn(is_hot, F.lit(True))), key, "left")
    wide = table.withColumn(found, F.lit(True))
    out = marked.where(F.col(is_hot)).join(F.broadcast(wide.join(F.broadcast(hot), key, "left_semi")), key, "left")
    out = out.unionByName(marked.where(F.col(is_hot).isNull() & F.col(key).isNotNull()).join(wide, key, "left"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in wide.schema if f.name != key]
    return out.unionByName(marked.where(F.col(key).isNull()).select("*", *missing)).drop(is_hot, found)
