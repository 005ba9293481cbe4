"""An interpolated Kneser-Ney language model, counted and scored with joins.

A model of order n knows, for every run of up to n tokens that training had, the
probability of its last token after the others, and for every context the weight
that goes to the shorter context.  The longest runs count how often they occur,
shorter ones before how many different tokens they follow; both are sums that
tasks add up before the shuffle.  Scoring looks the distinct runs of the texts up
and gives the results back to the documents.  Contexts, endings and runs that
very many rows share are looked up through :func:`joins.lookup`.

    p(w | h) = max(c(h w) - D, 0) / c(h) + D types(h) / c(h) p(w | shorter h)

and below single tokens one part in V, V being the tokens of training, the end
and one for all unknown tokens; so the probabilities of all tokens add up to one.

Defined cases: a null text is no document; a document without tokens is its end
alone; an unknown token has the probability of the unknown, and a context that
holds one falls back with weight one; rows that repeat count each time; without
training documents every token is unknown and has probability one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.shared import durable, unused
from .joins import lookup

#: Marks before a document and behind it; longer than any token of one sign.
BEGIN, END = "\x02begin", "\x03end"
DISCOUNT, ORDER = 0.75, 3


@dataclass
class Model:
    """``grams[k]``: ``gram, p`` and ``contexts[k]``: ``context, weight`` of runs of ``k + 1`` tokens; the probability of an unknown token."""

    order: int
    grams: list[DataFrame]
    contexts: list[DataFrame]
    unknown: float
    vocabulary: int


def _padded(tokens: Column, order: int) -> Column:
    return F.concat(F.array_repeat(F.lit(BEGIN), order - 1), tokens, F.array(F.lit(END)))


def runs(df: DataFrame, tokens: str, order: int, *keep: str) -> DataFrame:
    """``gram``: every run of ``order`` tokens that ends in a token or the end, with the columns ``keep``."""
    padded, *places = unused([*df.columns, "gram"], "padded", *(f"place{k}" for k in range(order)))
    # by once(), as Spark would cut the text again for a filter that it puts below
    rows = once(df.select(*keep, tokens), padded, _padded(F.col(tokens), order)).where(F.col(padded).isNotNull())
    n = F.size(padded) - (order - 1)
    # shifted arrays side by side; a lambda for each place is not compiled
    side_by_side = F.arrays_zip(*(F.slice(padded, F.lit(k + 1), n).alias(place) for k, place in enumerate(places)))
    return rows.select(*keep, F.inline(side_by_side)).select(*keep, F.array(*places).alias("gram"))


def fit(df: DataFrame, tokens: str, order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """The model of the documents' token arrays."""
    if order < 1 or not 0 < discount < 1:
        raise ValueError("the order is at least one and the discount between zero and one")
    counts: list[DataFrame] = [None] * order
    counts[-1], _ = durable(runs(df, tokens, order).groupBy("gram").agg(F.count("*").alias("c")), "grams")
    for k in range(order - 2, -1, -1):  # before how many tokens a run stands
        counts[k], _ = durable(counts[k + 1].groupBy(F.slice("gram", 2, k + 1).alias("gram")).agg(F.count("*").alias("c")), "grams")
    grams, contexts = [], []
    total, types = counts[0].agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    vocabulary = types + 1
    rest = discount * types / total if total else 1.0
    first = counts[0].select("gram", (F.greatest(F.col("c") - discount, F.lit(0.0)) / max(total, 1) + rest / vocabulary).alias("p"))
    grams.append(durable(first, "model")[0])
    contexts.append(None)
    for k in range(1, order):
        rows = counts[k].select("gram", "c", F.slice("gram", 1, k).alias("context"), F.slice("gram", 2, k).alias("ending"))
        sums, _ = durable(rows.groupBy("context").agg(F.sum("c").alias("total"), F.count("*").alias("types")), "contexts")
        weighted = sums.withColumn("weight", discount * F.col("types") / F.col("total"))
        met = lookup(rows, weighted, "context", sums.select("context", F.col("types").alias("n")))
        # an ending stands behind as many contexts as the shorter run's count says
        shorter = grams[k - 1].select(F.col("gram").alias("ending"), F.col("p").alias("below"))
        met = lookup(met, shorter, "ending", counts[k - 1].select(F.col("gram").alias("ending"), F.col("c").alias("n")))
        own = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below")
        grams.append(durable(met.select("gram", own.alias("p")), "model")[0])
        contexts.append(durable(weighted.select("context", "weight"), "contexts")[0])
    return Model(order, grams, contexts, rest / vocabulary, vocabulary)


def probabilities(model: Model, grams: DataFrame) -> DataFrame:
    """``gram, p`` of distinct runs of the model's order: the longest known ending, times the weights of the contexts passed over."""
    rows = grams.select("gram").withColumn("p", F.lit(None).cast("double")).withColumn("scale", F.lit(1.0))
    for k in range(model.order - 1, -1, -1):
        ending = F.when(F.col("p").isNull(), F.slice("gram", model.order - k, k + 1))
        known = model.grams[k].select(F.col("gram").alias("ending"), F.col("p").alias("own"))
        rows = lookup(rows.withColumn("ending", ending), known, "ending").withColumn("p", F.coalesce("p", F.col("scale") * F.col("own"))).drop("ending", "own")
        if k:
            context = F.when(F.col("p").isNull(), F.slice("gram", model.order - k, k))
            rows = lookup(rows.withColumn("context", context), model.contexts[k], "context").withColumn("scale", F.col("scale") * F.coalesce("weight", F.lit(1.0))).drop("context", "weight")
        rows, _ = durable(rows, "scored")  # so that no look-up counts again what came before
    return rows.select("gram", F.coalesce("p", F.col("scale") * model.unknown).alias("p"))


def perplexity(model: Model, df: DataFrame, tokens: str, key: str) -> DataFrame:
    """``key, n_tokens, log_prob, perplexity`` of each document, its end counted as a token; rows that share the key are one."""
    own, _ = durable(runs(df, tokens, model.order, key).groupBy(key, "gram").agg(F.count("*").alias("times")), "runs")
    frequent, _ = durable(own.groupBy("gram").agg(F.count("*").alias("n")), "frequent")
    scored = lookup(own, probabilities(model, frequent), "gram", frequent)
    out = scored.groupBy(key).agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log("p")).alias("log_prob"))
    return out.withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("n_tokens")))
