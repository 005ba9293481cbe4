"""A pairwise reward model on hashed features, fitted with gradients that tasks add up.

A text is the counts of its hashed tokens and token pairs, of ``width`` features;
a pair of answers is the chosen one's counts less the rejected one's.  The loss
is the mean of ``log(1 + exp(-w x))`` plus ``l2 / 2`` times the squared length of
``w``.  Each step broadcasts the weights and adds up the gradient: a task makes
one dense sum of ``width`` numbers, Spark sums those by range of features, and
only that sum, of a fixed size, comes to the driver, where L-BFGS picks the next
weights.  Features are hashed once and written; no example leaves its place.

Defined cases: null texts have no features; a pair of equal texts moves nothing
but counts in the mean; rows that repeat count each time; without pairs all
weights are zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_path, durable
from .tokens import simple_tokens

#: Features, steps of the fit and the gradient (largest entry) that ends it, remembered steps, and features of a summed piece.
WIDTH, STEPS, SMALL, MEMORY, PIECE = 1 << 16, 30, 1e-7, 8, 1 << 12


def features(text: Column, width: int = WIDTH) -> Column:
    """Hashed tokens and neighbouring pairs of a text, repeats included."""
    tokens = simple_tokens(F.coalesce(text, F.lit("")))
    single = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(width)).cast("int"))
    return F.concat(single, pairs)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a batch in a row, and the row of each."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _margins(weights: np.ndarray, chosen: tuple, rejected: tuple, rows: int) -> np.ndarray:
    return np.bincount(chosen[1], weights[chosen[0]], rows) - np.bincount(rejected[1], weights[rejected[0]], rows)


def loss_and_gradient(pairs: DataFrame, weights: np.ndarray, l2: float, rows: int) -> tuple[float, np.ndarray]:
    """Of hashed pairs (``chosen, rejected``): one job, one sum of the width of the weights."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)  # WIDTH numbers
    width = len(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, loss = shared.value, np.zeros(width), 0.0
        for batch in batches:
            a, b = _flat(batch.column(0)), _flat(batch.column(1))
            margin = _margins(w, a, b, batch.num_rows)
            loss += float(np.logaddexp(0, -margin).sum())
            pull = -1 / (1 + np.exp(np.clip(margin, -500, 500)))
            total += np.bincount(a[0], pull[a[1]], width) - np.bincount(b[0], pull[b[1]], width)
        pieces = [total[at : at + PIECE] for at in range(0, width, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(pieces))], pa.int32()), pa.array([[loss], *pieces], pa.list_(pa.float64()))], names=["piece", "sum"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "sum": [np.sum(np.stack(pdf["sum"].tolist()), axis=0)]})

    summed = pairs.mapInArrow(add, "piece int, sum array<double>")
    # in two steps, so that no task adds up a piece of every task of the input
    some = summed.withColumn("team", F.spark_partition_id() % 64).groupBy("piece", "team").applyInPandas(merged, "piece int, sum array<double>")
    got = {r["piece"]: r["sum"] for r in some.groupBy("piece").applyInPandas(merged, "piece int, sum array<double>").collect()}  # WIDTH + 1 numbers
    shared.destroy()
    gradient = np.concatenate([np.array(got[k]) for k in range(len(got) - 1)]) if got else np.zeros(width)
    loss = got[-1][0] if got else 0.0
    return loss / rows + l2 / 2 * float(weights @ weights), gradient / rows + l2 * weights


def minimize(measure: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = STEPS, small: float = SMALL) -> np.ndarray:
    """L-BFGS with a backtracking line search; ``measure`` gives a value and a gradient."""
    at, (value, slope) = start, measure(start)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max(initial=0.0) <= small:
            break
        way, used = slope.copy(), []
        for s, y in reversed(history):
            share = (s @ way) / (y @ s)
            way -= share * y
            used.append((share, s, y))
        if history:
            s, y = history[-1]
            way *= (s @ y) / (y @ y)
        for share, s, y in reversed(used):
            way += (share - (y @ way) / (y @ s)) * s
        size = 1.0 if history else 1 / max(1.0, float(np.linalg.norm(slope)))
        for _ in range(30):
            there = at - size * way
            new, turned = measure(there)
            if new <= value - 1e-4 * size * float(way @ slope):
                break
            size /= 2
        else:
            break
        if float((there - at) @ (turned - slope)) > 1e-12:
            history = [*history[-(MEMORY - 1) :], (there - at, turned - slope)]
        at, value, slope = there, new, turned
    return at


def fit(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", width: int = WIDTH, l2: float = 1e-3, steps: int = STEPS) -> np.ndarray:
    """Weights of the features, from pairs of answers."""
    hashed, path = durable(pairs.select(features(F.col(chosen), width).alias("chosen"), features(F.col(rejected), width).alias("rejected")), "pairs")
    rows = hashed.count()
    if not rows:
        return np.zeros(width)
    weights = minimize(lambda w: loss_and_gradient(hashed, w, l2, rows), np.zeros(width), steps)
    drop_path(pairs.sparkSession, path)
    return weights


def score(df: DataFrame, weights: np.ndarray, text: str, out: str = "model_score") -> DataFrame:
    """``df`` with the model's score of a text, for ``rewards.reward_model`` and for accuracies."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # WIDTH numbers

    @F.pandas_udf("double")
    def scored(found: pd.Series) -> pd.Series:
        w = shared.value
        return found.map(lambda own: float(w[np.asarray(own, dtype=np.int64)].sum()))

    return df.withColumn(out, scored(features(F.col(text), len(weights))))
