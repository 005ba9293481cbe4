"""Canonical records from heterogeneous sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import group_key, stable_split
from ..functions.text import nonblank, strip, truthy

# Aliases, classification terms and aspects.
TASK_ALIASES = {"classical_to_modern": "old_to_modern", "translation": "old_to_modern", "modern_to_classical": "modern_to_old", "analysis": "appreciation", "writing": "creation"}
INSTRUCTION_ALIASES = {"c2m": "old_to_modern", "m2c": "modern_to_old", "punctuate": "punctuation"}
TO_CLASSICAL = ("翻译成古文", "翻译成文言", "译成文言", "modern to classical")
TO_MODERN = ("翻译成现代", "翻译成白话", "译为白话", "文言文翻译", "classical to modern")
CREATION_TAGS = ("firefly_AncientPoem", "firefly_Couplet", "firefly_JinYongGeneration")
CREATION = ("写诗", "作诗", "诗词创作", "对联", "仿写", "续写")
APPRECIATION = ("赏析", "鉴赏", "思想感情", "表达手法")
ASPECTS = ("intent", "subject", "theme", "thought", "emotion")
#: Our own wording of the question for each aspect.
ASPECT_QUESTIONS = {
    "intent": "这首诗为何而作？请引诗句说明。",
    "subject": "这首诗写的是什么题材？请给出诗中的依据。",
    "theme": "这首诗的主旨是什么？请结合原句解释。",
    "thought": "这首诗寄托了怎样的思想？请引原句为证。",
    "emotion": "这首诗抒发了怎样的情感？请指出有关诗句。",
}


@dataclass
class Source:
    """One entry of the source registry."""

    name: str
    kind: str
    path: str
    category: str
    license: str = "unknown"
    mode: str = "corpus"
    text_fields: tuple[str, ...] = ("text", "content")
    fields: dict = field(default_factory=dict)
    revision: str | None = None
    max_documents: int | None = None
    enabled: bool = True


def column(df: DataFrame, name: str) -> Column:
    """A column as text, null where the frame lacks it."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def pick_text(df: DataFrame, fields: tuple[str, ...]) -> Column:
    """The first field with visible text, as it is."""
    return F.coalesce(*(F.when(nonblank(column(df, f)), column(df, f)) for f in fields), F.lit(None).cast("string"))


def scalar_metadata(df: DataFrame, text_fields: tuple[str, ...]) -> Column:
    """Scalar fields other than the texts, as a map without nulls."""
    flat = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and f.name not in text_fields and not f.name.startswith("__")]
    pairs = [F.struct(F.lit(n).alias("k"), column(df, n).alias("v")) for n in flat]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def records(df: DataFrame, source: Source, text: Column, index: Column, seed: int | str, suffix: Column | None = None) -> DataFrame:
    """``df`` with the canonical columns.  ``index`` is the row's ordinal in its source."""
    source_id = F.concat(F.lit(f"{source.name}:"), index.cast("string"))
    work = truthy(*(column(df, c) for c in ("source", "work", "title", "chapter")))
    canonical = {
        "source_id": source_id,
        "id": source_id if suffix is None else F.concat(source_id, suffix),
        "dataset": F.lit(source.path),
        "license": F.lit(source.license),
        "category": F.lit(source.category),
        "text": text,
        "work": work,
        "author": truthy(column(df, "author")),
        "dynasty": truthy(column(df, "era"), column(df, "dynasty")),
        "metadata": scalar_metadata(df, source.text_fields),
    }
    out = df.select(*[c.alias(n) for n, c in canonical.items()], *[F.col(f"`{c}`") for c in df.columns if c not in canonical and not c.startswith("__")])
    return out.withColumn("split", stable_split(group_key({"work": F.col("work"), "source_id": F.col("source_id"), "id": F.col("id")}), seed))


def corpus(df: DataFrame, source: Source, index: str, seed: int | str) -> DataFrame:
    """Plain texts: rows without visible text are skipped."""
    return records(df, source, pick_text(df, source.text_fields), F.col(index), seed).where("text is not null")


def translation_pairs(df: DataFrame, source: Source, index: str, seed: int | str, old: str = "classical", new: str = "modern") -> DataFrame:
    """Both directions of each pair with text on both sides; they share a source id and so a split."""
    a, b = strip(column(df, old)), strip(column(df, new))
    usable = df.withColumn("classical", a).withColumn("modern", b).where(nonblank(a) & nonblank(b))
    way = lambda task, x, y: F.struct(F.lit(task).alias("task"), x.alias("input"), y.alias("output"))
    both = usable.withColumn("__way", F.explode(F.array(way("old_to_modern", F.col("classical"), F.col("modern")), way("modern_to_old", F.col("modern"), F.col("classical")))))
    spread = both.drop("task", "input", "output").select("*", "__way.*").drop("__way")
    return records(spread, source, F.concat_ws("\n", "input", "output"), F.col(index), seed, F.concat(F.lit(":"), F.col("task")))


def classify_instruction(instruction: Column, tag: Column) -> Column:
    """Task of an instruction by ordered rules; null where none is clear."""
    value = F.lower(F.concat(F.coalesce(instruction, F.lit("")), F.lit("\n"), F.coalesce(tag, F.lit(""))))

    def has(terms):
        return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(value, t))

    return F.when(has(TO_CLASSICAL), "modern_to_old").when(has(TO_MODERN), "old_to_modern").when(F.coalesce(tag.isin(*CREATION_TAGS), F.lit(False)), "creation").when(has(CREATION), "creation").when(has(APPRECIATION), "appreciation")


def generic_instructions(df: DataFrame, source: Source, index: str, seed: int | str) -> DataFrame:
    """Instruction rows whose task is clear and that have an answer and a question."""
    instruction, given, answer = (strip(F.coalesce(column(df, c), F.lit(""))) for c in ("instruction", "input", "output"))
    task = classify_instruction(instruction, column(df, "source"))
    prompt = F.concat_ws("\n", F.when(instruction != "", instruction), F.when(given != "", given))
    usable = df.withColumn("task", task).withColumn("__prompt", prompt).withColumn("output", answer).where((F.col("task").isNotNull()) & (F.col("output") != "") & (F.col("__prompt") != ""))
    usable = usable.withColumn("input", F.col("__prompt"))
    return records(usable, source, F.concat_ws("\n", "input", "output"), F.col(index), seed)


def task_instructions(df: DataFrame, source: Source, index: str, seed: int | str) -> DataFrame:
    """Instruction rows with a task column; directions fill ``classical`` and ``modern``."""
    task = alias(column(df, "task"), INSTRUCTION_ALIASES)
    given, answer = F.coalesce(column(df, "input"), F.lit("")), F.coalesce(column(df, "output"), F.lit(""))
    text = F.when(task == "punctuation", answer).otherwise(F.concat_ws("\n", given, answer))
    rows = df.withColumn("task", task).withColumn("classical", F.when(task == "old_to_modern", given).when(task == "modern_to_old", answer)).withColumn("modern", F.when(task == "old_to_modern", answer).when(task == "modern_to_old", given))
    return records(rows, source, text, F.col(index), seed).where(nonblank(F.col("text")))


def poetry_appreciation(poems: DataFrame, analyses: DataFrame, source: Source, index: str, analysis_order: str, seed: int | str) -> DataFrame:
    """Poems joined to their last analysis, one row for each aspect that has an answer."""
    notes = analyses.groupBy(F.col("id").cast("string").alias("__id")).agg(F.max_by(F.struct(*ASPECTS), analysis_order).alias("__note"))
    if source.max_documents is not None:  # the limit counts poems, matched or not
        poems = poems.where(F.col(index) < source.max_documents)
    met = poems.join(notes, F.col("id").cast("string") == F.col("__id")).withColumn("__poem", strip(column(poems, "text"))).where("__poem <> ''")
    aspects = F.array(*(F.struct(F.lit(a).alias("analysis_aspect"), F.lit(ASPECT_QUESTIONS[a]).alias("instruction"), strip(F.coalesce(F.col(f"__note.{a}").cast("string"), F.lit(""))).alias("output")) for a in ASPECTS))
    rows = met.withColumn("__a", F.explode(aspects)).select("*", "__a.*").drop("__a").where("output <> ''").withColumn("task", F.lit("appreciation")).withColumn("input", F.concat_ws("\n", "instruction", "__poem"))
    return records(rows, source, F.concat_ws("\n", "input", "output"), F.col(index), seed, F.concat(F.lit(":"), F.col("analysis_aspect")))


def alias(task: Column, names: dict[str, str] = TASK_ALIASES) -> Column:
    """A task under its usual name; unknown ones pass."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[task], task)


MODES = {"corpus": corpus, "translation_pair": translation_pairs, "generic_sft": generic_instructions, "instruction": task_instructions}


def shortened(message: str, most: int = 500) -> str:
    """A message, or its beginning and end: Spark puts the cause last."""
    text = message.strip()
    return text if len(text) <= most else f"{text[: most // 2]} ... {text[-most // 2 :]}"


def acquire(spark, sources: list[Source], load, index: str, seed: int | str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Normalise every enabled source with ``load(source)``; one that fails does not stop the others.

    Returns the frames and a report row for each source.
    """
    frames, report = {}, []
    for s in sources:
        if not s.enabled:
            continue
        try:
            df = load(s)
            if s.max_documents is not None:
                df = df.where(F.col(index) < s.max_documents)
            frames[s.name] = MODES[s.mode](df, s, index, seed)
            report.append((s.name, frames[s.name].count(), s.path, s.license, s.revision, None))
        except Exception as wrong:  # recorded, and the next source goes on
            frames.pop(s.name, None)
            report.append((s.name, 0, s.path, s.license, s.revision, shortened(str(wrong))))
    return frames, spark.createDataFrame(report, "name string, rows long, path string, license string, revision string, error string")
