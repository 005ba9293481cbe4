"""Token sequences: chunking, quota mixtures, packing and token-weighted loss."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash
from ..sources.shared import unused
from .sampling import QuotaError

# Chunk, epoch and block limits.
MAX_TOKENS, MAX_EPOCHS, MIN_BLOCK = 2048, 2, 8


def simple_tokens(text: Column) -> Column:
    """The default tokenizer, all in the JVM: runs of ASCII letters or digits, and every other visible character."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9\\s]"), F.lit(0))


def simple_pieces(text: Column) -> Column:
    """The text cut behind each default token: white space goes with the token that follows, at the end with the last one.  Joined, the pieces are the text (none where it has no token)."""
    return F.regexp_extract_all(text, F.lit("\\s*+(?:[A-Za-z0-9]++|[^A-Za-z0-9\\s])(?:\\s++\\z)?"), F.lit(0))


@dataclass(frozen=True)
class Tokenizer:
    """From a text to tokens (strings) and back, and the text cut into a piece for each token where that is known."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    pieces: Callable[[Column], Column] | None = None


#: Decoding alone puts a space between tokens, as white space is no token; pieces keep it.
SIMPLE = Tokenizer(simple_tokens, lambda tokens: F.array_join(tokens, " "), simple_pieces)


def _cut(text: str, ends: list[int]) -> list[str]:
    """Pieces of a text that end where its tokens do; what is left over goes with the last."""
    ends = [*ends[:-1], len(text)] if ends else []
    return [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def library_tokenizer(load: Callable[[], tuple]) -> Tokenizer:
    """A tokenizer of a library in Arrow batches.

    ``load`` gives its encode and decode functions, and if there is a third one,
    that gives the (start, end) of each token in the text, in rising order; it is
    called once a batch stream.
    """

    def mapped(pick: int, call: Callable, kind: str):
        def of(batches):
            functions = load()
            for batch in batches:
                yield batch.map(lambda x: None if x is None else call(functions[pick], x))

        from collections.abc import Iterator

        of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(kind)(of)

    pieces = mapped(2, lambda offsets, t: _cut(t, [e for _, e in offsets(t)]), "array<string>") if len(load()) > 2 else None
    return Tokenizer(mapped(0, lambda encode, t: list(encode(t)), "array<string>"), mapped(1, lambda decode, t: decode(list(t)), "string"), pieces)


def chunk(df: DataFrame, tokens: str, key: str, most: int = MAX_TOKENS, pieces: str | None = None) -> DataFrame:
    """A row for each run of up to ``most`` tokens: ``parent_source_id, chunk_index, tokens``; none for a row without tokens.

    ``pieces``: a column with the text cut into a piece for each token.  It is
    cut like the tokens, and ``text_start`` and ``text_end`` (characters) say
    where the chunk lies in the text: chunks laid end to end are the text.
    """
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(most))).otherwise(F.array().cast("array<int>"))
    at, sizes, span = unused([*df.columns, "parent_source_id", "chunk_index", "text_start", "text_end"], "at", "sizes", "span")
    if pieces is not None:
        lengths = F.transform(starts, lambda k: F.length(F.array_join(F.slice(F.col(pieces), k + 1, F.lit(most)), "")))
        own = lambda k, i: F.struct(k.alias("at"), F.aggregate(F.slice(F.col(sizes), F.lit(1), i), F.lit(0), lambda x, y: x + y).alias("from"), F.get(F.col(sizes), i).alias("size"))
        spread = df.withColumn(sizes, lengths).withColumn(span, F.explode(F.transform(starts, own))).withColumn(at, F.col(f"{span}.at"))
        spread = spread.withColumn("text_start", F.col(f"{span}.from")).withColumn("text_end", F.col(f"{span}.from") + F.col(f"{span}.size"))
        spread = spread.withColumn(pieces, F.slice(F.col(pieces), F.col(at) + 1, F.lit(most))).drop(sizes, span)
    else:
        spread = df.withColumn(at, F.explode(starts))
    piece = F.slice(F.col(tokens), F.col(at) + 1, F.lit(most))
    return spread.withColumn("parent_source_id", F.col(key)).withColumn("chunk_index", (F.col(at) / most).cast("int")).withColumn(tokens, piece).drop(at)


#: Rows that one task adds up in order.
ROWS_A_BUCKET = 500_000


def _last_rows(rows: DataFrame, quotas: dict[str, int], buckets: int) -> dict[str, tuple]:
    """``(epoch, hash, key, tie, tokens left)`` of the row that reaches each quota, from ``category, epoch, hash, key, tie, n``.

    Two steps, so that a category of any size is spread over ``buckets``
    tasks: sums within ranges of the hash, of which the quota falls into one;
    then a running sum over the rows of that range alone.
    """
    bucket = (F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long")
    own = rows.withColumn("bucket", bucket)
    heads = ["category", "epoch", "bucket"]
    sums = own.groupBy(*heads).agg(F.sum("n").alias("sum"))
    ahead = Window.partitionBy("category").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))[F.col("category")]
    # a row for each category, epoch and bucket
    base = sums.select(*heads, "sum", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"), quota.alias("quota")).where("base < quota and base + sum >= quota")
    inside = Window.partitionBy(*heads).orderBy("hash", "key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    met = own.join(base.select(*heads, "base", "quota"), heads).withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    last = met.where("before < quota and before + n >= quota").select("category", "epoch", "hash", "key", "tie", (F.col("quota") - F.col("before")).alias("left"))
    return {r["category"]: (r["epoch"], r["hash"], r["key"], r["tie"], r["left"]) for r in last.collect()}  # a row a category


def token_mixture(df: DataFrame, fractions: dict[str, float], total: int, seed: int | str, key: str, category: str = "category", tokens: str = "tokens", epochs: int = MAX_EPOCHS, tie: str | None = None) -> DataFrame:
    """Rows of ``df`` (chunks) that fill each category's share of ``total`` tokens exactly.

    Each row counts its tokens and one end token.  Rows come in hash order,
    up to ``epochs`` times; the row that crosses the quota is cut to what
    remains.  ``key`` tells rows apart (not null); where it may repeat, ``tie``
    names a column of numbers that tells those rows apart, and without one a
    repeated key raises.  Raises when a category is short.  Adds ``token_count`` and ``mixture_epoch``; the result is in no
    order.  Only keys and counts are added up: the rows themselves are
    filtered where they are, up to the one that reaches the quota.
    """
    if abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError(f"fractions sum to {sum(fractions.values())}")
    quotas = {c: round(total * f) for c, f in fractions.items()}
    pool = df.where(F.col(category).isin(*quotas)).withColumn("token_count", (F.size(tokens) + 1).cast("long"))
    found = {r[category]: r for r in pool.groupBy(category).agg(F.sum("token_count").alias("n"), F.count("*").alias("rows")).collect()}
    have = {c: epochs * (found[c]["n"] if c in found else 0) for c in quotas}
    if short := {c: n for c, n in have.items() if n < quotas[c]}:
        raise QuotaError(f"too few tokens: {short}, wanted {quotas}")
    if tie is None and not (again := pool.groupBy(F.col(key).alias("key")).count().where("count > 1").limit(1)).isEmpty():
        raise ValueError(f"the key {again.first()['key']!r} stands for several rows")
    hashed, name, last_key = unused([*pool.columns, "mixture_epoch"], "hash", "key", "tie")
    passes = pool.withColumn("mixture_epoch", F.explode(F.array(*map(F.lit, range(epochs))))).withColumn(name, F.col(key).cast("string")).withColumn(last_key, F.lit(0).cast("long") if tie is None else F.col(tie).cast("long"))
    ordered = passes.withColumn(hashed, keyed_hash(str(seed), F.col("mixture_epoch"), F.col(name)))
    narrow = ordered.select(F.col(category).alias("category"), F.col("mixture_epoch").alias("epoch"), F.col(hashed).alias("hash"), F.col(name).alias("key"), F.col(last_key).alias("tie"), F.col("token_count").alias("n"))
    rows = max((r["rows"] for r in found.values()), default=0)
    keep, left = F.lit(False), F.col("token_count")
    place = F.struct(F.col("mixture_epoch").alias("e"), F.col(hashed).alias("h"), F.col(name).alias("k"), F.col(last_key).alias("t"))
    for c, (epoch, at, own, copy, rest) in _last_rows(narrow, {c: q for c, q in quotas.items() if q > 0}, max(64, -(-rows // ROWS_A_BUCKET))).items():
        last = F.struct(F.lit(epoch).alias("e"), F.lit(at).alias("h"), F.lit(own).alias("k"), F.lit(copy).cast("long").alias("t"))
        keep = keep | ((F.col(category) == c) & (place <= last))
        left = F.when((F.col(category) == c) & (place == last), F.lit(rest).cast("long")).otherwise(left)
    kept = ordered.where(keep).withColumn("token_count", left)
    return kept.withColumn(tokens, F.slice(F.col(tokens), F.lit(1), (F.col("token_count") - 1).cast("int"))).drop(hashed, name, last_key)


def mixture_manifest(mixed: DataFrame, category: str = "category") -> DataFrame:
    """Achieved rows and tokens of each category."""
    return mixed.groupBy(category).agg(F.count("*").alias("rows"), F.sum("token_count").alias("tokens"))


def pack_blocks(df: DataFrame, tokens: str, order: str, block: int, groups: str, end: str = "<eos>", least: int = MIN_BLOCK) -> DataFrame:
    """Documents joined by an end token and cut into blocks: ``pack_group, block_index, tokens``.

    Blocks never cross ``groups`` (a bounded batch of documents); those under
    ``least`` tokens are dropped.
    """
    whole = df.select(F.col(groups).alias("pack_group"), F.col(order).alias("__order"), F.array_append(F.col(tokens), F.lit(end)).alias("__t"))
    before = F.coalesce(F.sum(F.size("__t")).over(Window.partitionBy("pack_group").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # documents are sliced at block borders rather than token by token
    placed = whole.withColumn("__at", before).withColumn("__first", F.floor(F.col("__at") / block)).withColumn("__last", F.floor((F.col("__at") + F.size("__t") - 1) / block))
    parts = placed.withColumn("block_index", F.explode(F.sequence("__first", "__last")))
    start = F.greatest(F.col("block_index") * block - F.col("__at"), F.lit(0))
    stop = F.least((F.col("block_index") + 1) * block - F.col("__at"), F.size("__t"))
    pieces = parts.select("pack_group", "block_index", (F.col("__at") + start).alias("at"), F.slice(F.col("__t"), (start + 1).cast("int"), (stop - start).cast("int")).alias("piece"))
    joined = pieces.groupBy("pack_group", "block_index").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"])).alias("tokens"))
    return joined.where(F.size("tokens") >= least)


def completion_mask(prompt: Column, completion: Column, most: int = 1024) -> Column:
    """0 for each prompt token and 1 for each of the completion, cut to ``most``."""
    return F.slice(F.concat(F.array_repeat(F.lit(0), F.size(prompt)), F.array_repeat(F.lit(1), F.size(completion))), F.lit(1), F.lit(most))


def perplexity(chunks: DataFrame, loss: Column, tokens: str = "tokens", groups: list[str] | None = None) -> DataFrame:
    """Token-weighted perplexity of non-overlapping chunks; chunks under two tokens are skipped."""
    weight = (F.size(tokens) - 1).cast("long")
    usable = chunks.where(F.size(tokens) >= 2)
    mean = F.sum(loss * weight) / F.sum(weight)
    return usable.groupBy(*(groups or [])).agg(F.exp(F.least(mean, F.lit(80.0))).alias("perplexity"), F.sum(weight).alias("predicted_tokens"))


def length_audit(tokens: Column, prompt_tokens: Column, answer: Column, end_mark: str, limit: int = 1024) -> dict[str, Column]:
    """Counters for a training-data audit."""
    return {
        "at_limit": F.count_if(F.size(tokens) >= limit),
        "over_limit": F.count_if(F.size(tokens) > limit),
        "prefix_mismatch": F.count_if(F.slice(tokens, 1, F.size(prompt_tokens)) != prompt_tokens),
        "end_kept": F.count_if(F.array_contains(F.slice(tokens, 1, limit), end_mark)),
        "short_answer": F.count_if(F.length(answer) < 10),
    }
