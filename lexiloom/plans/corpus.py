"""End-to-end corpus plans: preparation, mixtures, evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import text as T
from ..functions.hashing import group_key, sha256_hex, stable_split
from ..operators import chat, tokens
from ..operators.acquire import column
from ..operators.dedup import duplicate_kinds, first_by, simhash
from ..operators.sampling import balanced, capped, ordinals
from ..sources.shared import durable, unused

#: Seed, tasks and categories of the evaluation sets.
SEED = 20260912
EVAL_TASKS = ("old_to_modern", "modern_to_old", "appreciation", "creation")
GENERAL = ("classical", "general_zh", "general_en")
GROUP_FIELDS = ("work", "source_group", "source_id", "url", "id")
DEFAULT_CATEGORY = "general_zh"


def normalized(df: DataFrame, entities: bool = True, once: bool = False) -> DataFrame:
    """``df`` with normalised ``text`` (``content`` where there is no text) and ``category``; ``once``: by :func:`T.once`."""
    raw = F.coalesce(T.truthy(column(df, "text"), column(df, "content")), F.lit(""))
    put = T.once if once else DataFrame.withColumn
    return put(df, "text", T.normalize_text(raw, entities)).withColumn("category", F.coalesce(column(df, "category"), F.lit(DEFAULT_CATEGORY)))


def judged(df: DataFrame, entities: bool = True, once: bool = False) -> DataFrame:
    """Normalised rows with ``reasons`` and ``quality_score``; ``once``: texts and reasons by :func:`T.once`."""
    put = T.once if once else DataFrame.withColumn
    rows = put(normalized(df, entities, once), "reasons", quality.reasons(F.col("text"), F.col("category")))
    return rows.withColumn("quality_score", quality.score(F.col("text"), F.col("reasons")))


def prepare(df: DataFrame, order: str, seed: int = SEED, entities: bool = True, fingerprint: str = "blake2b", max_features: int | None = None) -> DataFrame:
    """All rows with ``reasons``; those without any are the kept corpus, with score, hash, split and final category.

    ``order`` numbers the rows (not null).  A null or empty text is too short,
    a missing category is ``general_zh``; columns of the result replace those
    of the same name.  ``fingerprint``: the hash of the near-duplicate
    fingerprint, of all trigrams of a text; ``max_features``: of so many evenly
    spaced ones of a longer text.
    """
    number, key, fp = unused([*df.columns, "reasons", "duplicate_of_kind"], "number", "key", "fp")
    rows = judged(df, entities, once=True)
    # normalising is done twice, once here and once for the result; only ids, keys and fingerprints are written
    good = T.once(rows.where(F.size("reasons") == 0).select(F.col(f"`{order}`").alias(number), "text"), key, T.dedup_key(F.col("text")))
    facts, _ = durable(good.select(number, sha256_hex(F.col(key)).alias(key), simhash(F.col(key), fingerprint, max_features).alias(fp)), "fingerprints")
    kinds = duplicate_kinds(facts.where(F.col(fp).isNotNull()), number, key, fp)
    out = rows.join(kinds.hint("merge"), F.col(f"`{order}`") == F.col(number), "left").withColumn("reasons", F.when(F.col("duplicate_of_kind").isNotNull(), F.array("duplicate_of_kind")).otherwise(F.col("reasons")))
    group = group_key({f: column(df, f) for f in GROUP_FIELDS if f in df.columns} or {"id": F.col(order)})
    # relabelled after the decision, so the stricter rules of the new category do not apply
    technical = (F.col("category") == DEFAULT_CATEGORY) & quality.looks_technical(F.col("text"))
    return out.withColumn("category", F.when(technical, "stem_technical").otherwise(F.col("category"))).withColumn("content_hash", sha256_hex(F.col("text"))).withColumn("split", stable_split(group, seed)).drop(number, "duplicate_of_kind")


def audit(prepared: DataFrame, source: str = "source") -> DataFrame:
    """``kind, name, rows``: accepted by split, reasons (a row may have several), kept by source."""
    kept = F.size("reasons") == 0
    facts = F.concat(
        F.when(kept, F.array(F.struct(F.lit("split").alias("kind"), F.col("split").alias("name")), F.struct(F.lit("source").alias("kind"), F.coalesce(T.truthy(F.col(source).cast("string")), F.lit("unknown")).alias("name")))).otherwise(F.array()),
        F.transform("reasons", lambda r: F.struct(F.lit("rejected").alias("kind"), r.alias("name"))),
    )
    # one pass and one shuffle for all three counts
    return prepared.select(F.explode(facts).alias("f")).groupBy("f.kind", "f.name").agg(F.count("*").alias("rows"))


def mixture(prepared: DataFrame, fractions: dict[str, float], total: int, seed: int = SEED, key: str | None = None, tokenizer: tokens.Tokenizer = tokens.SIMPLE, most: int = tokens.MAX_TOKENS) -> DataFrame:
    """Tokenise, chunk, and fill each category's quota; ``text`` is the chunk's slice of the text where the tokenizer tells its pieces, else its decoded tokens.

    A chunk's parent is ``key``, or the first of ``source_id`` and ``id`` that is
    not empty.  Records may share a parent, and rows may repeat: chunks are told
    apart by parent, id, text and place in it, and those that have all of these
    in common by their order in the scan.
    """
    parent = T.truthy(column(prepared, key)) if key else T.truthy(column(prepared, "source_id"), column(prepared, "id"))
    own, pieces, tie, chunk_key = unused([*prepared.columns, "tokens", "token_count", "mixture_epoch"], "own", "pieces", "tie", "chunk_key")
    rows = ordinals(prepared, tie).withColumn(own, F.coalesce(parent, F.raise_error(F.lit("a row has no source_id and no id")))).withColumn("tokens", tokenizer.encode(F.col("text")))
    if tokenizer.pieces:
        rows = rows.withColumn(pieces, tokenizer.pieces(F.col("text")))
    identity = F.concat_ws("#", F.col(own), F.coalesce(column(prepared, "id"), F.lit("")), F.sha2("text", 256))
    cut = tokens.chunk(rows.withColumn(chunk_key, identity), "tokens", own, most, pieces if tokenizer.pieces else None)
    cut = cut.withColumn(chunk_key, F.concat_ws("#", chunk_key, F.col("chunk_index").cast("string"))).withColumn("chunk_id", F.concat_ws("#", "parent_source_id", F.col("chunk_index").cast("string")))
    mixed = tokens.token_mixture(cut, fractions, total, seed, chunk_key, tie=tie).drop(own, tie, chunk_key)
    if not tokenizer.pieces:
        return mixed.withColumn("text", tokenizer.decode(F.col("tokens")))
    # the chunk that reaches the quota is cut, and its text with it
    text = F.array_join(F.slice(F.col(pieces), F.lit(1), F.size("tokens")), "")
    return mixed.withColumn("text", text).withColumn("text_end", F.col("text_start") + F.length("text")).drop(pieces)


def evaluation_rows(df: DataFrame) -> DataFrame:
    """Held-out rows with task, prompt and reference, first of equal ones; the id is a hash of task and prompt.

    Rows without a prompt of their own take their messages but the last as the
    prompt, those without a reference the last message, whatever its role.
    Other columns stay as they are.
    """
    messages = F.col("messages") if "messages" in df.columns else F.lit(None).cast(chat.MESSAGES)
    some = F.coalesce(F.size(messages) > 0, F.lit(False))
    before, last = chat.prompt_and_completion(messages)
    own = F.coalesce(T.truthy(column(df, "prompt")), column(df, "input"))
    answer = F.coalesce(T.truthy(column(df, "reference"), column(df, "output")), column(df, "answer"))
    prompt = F.when(own.isNull() & some, F.to_json(before)).otherwise(own)
    reference = F.when(answer.isNull() & some, F.get(last, F.lit(0))["content"]).otherwise(answer)
    identity, asked, given = unused(df.columns, "identity", "asked", "given")
    rows = df.withColumns({asked: prompt, given: reference}).where((column(df, "split") == "test") & (F.coalesce(column(df, "task"), F.lit("")) != "") & (F.coalesce(asked, F.lit("")) != "") & (F.coalesce(given, F.lit("")) != ""))
    rows = rows.withColumn(identity, sha256_hex(F.concat_ws("\x00", "task", asked)))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("id", "task", "prompt", "reference")]
    return first_by(rows, [identity], [column(df, "id")]).select(F.col(identity).alias("id"), "task", F.col(asked).alias("prompt"), F.col(given).alias("reference"), *kept)


def domain_evaluation(df: DataFrame, per_task: int = 100, seed: int = SEED, tasks: tuple[str, ...] = EVAL_TASKS) -> DataFrame:
    """The same number of held-out rows of each task; raises when one is short."""
    return balanced(evaluation_rows(df), "task", list(tasks), per_task, seed, "id")


def perplexity_sets(df: DataFrame, per_category: int = 200, seed: int = SEED, categories: tuple[str, ...] = GENERAL, key: str = "id") -> DataFrame:
    """Up to so many texts of each category from held-out rows (all of ``df``); raises where a category has none."""
    return capped(df.where(F.coalesce(F.col("text"), F.lit("")) != ""), "category", list(categories), per_category, seed, key)


def score_generations(df: DataFrame, response: Column, reference: Column) -> DataFrame:
    """``df`` with chrF, repetition, length and exact match."""
    return df.withColumn("chrf", T.chrf(response, reference)).withColumn("repetition", T.repetition(response)).withColumn("length", T.compact_length(response)).withColumn("exact", (T.compact(response) == T.compact(reference)).cast("double"))
