"""Source registry, staged scans and schema inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.acquire import Source
from . import jsonsource
from .shared import exists

#: Keys that an entry may have.
KEYS = ("name", "kind", "path", "category", "license", "mode", "text_fields", "fields", "revision", "max_documents", "enabled")


def parse(config: dict) -> list[Source]:
    """Entries under ``sources``; unknown keys and repeated names raise."""
    if not isinstance(config, dict) or not isinstance(config.get("sources"), list):
        raise ValueError("the configuration must map 'sources' to a list")
    out = []
    for entry in config["sources"]:
        if unknown := set(entry) - set(KEYS):
            raise ValueError(f"unknown keys {sorted(unknown)} in source {entry.get('name')}")
        out.append(Source(**{k: tuple(v) if k == "text_fields" else v for k, v in entry.items()}))
    if len({s.name for s in out}) != len(out):
        raise ValueError("source names repeat")
    return out


def path_of(spark: SparkSession, source: Source) -> str:
    """Where a source is read: the folder of its revision, which must be there, if it names one."""
    if not source.revision:
        return source.path
    path = f"{source.path.rstrip('/')}/{source.revision}"
    if "/" in source.revision or not exists(spark, path):
        raise FileNotFoundError(f"no revision {source.revision!r} of {source.name} at {source.path}")
    return path


def load(spark: SparkSession, source: Source) -> DataFrame:
    """A staged source by its kind: Parquet, ORC, JSON lines, CSV or text; JSON lines strictly, of a bounded source only its first lines."""
    path, read = path_of(spark, source), spark.read
    if source.kind == "json":
        schema = jsonsource.infer(spark, path)
        return jsonsource.read(spark, path, schema) if source.max_documents is None else jsonsource.first_rows(spark, path, schema, source.max_documents)
    kinds = {"parquet": read.parquet, "orc": read.orc, "csv": lambda p: read.option("header", True).csv(p), "text": read.text}
    if source.kind not in kinds:
        raise ValueError(f"no reader for kind {source.kind}")
    return kinds[source.kind](path)


def numbered(spark: SparkSession, source: Source, index: str) -> DataFrame:
    """A staged source with each row's ordinal in it, by file and place."""
    return sampling.ordinals(load(spark, source), index)


def inspect(df: DataFrame, preview: int = 500) -> DataFrame:
    """``field, type, preview`` of the first row."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    fields = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(t).alias("type"), F.substring(F.col(f"`{n}`").cast("string"), 1, preview).alias("preview")) for n, t in types.items()))
    return df.limit(1).select(F.explode(fields).alias("f")).select("f.*")


def union_inputs(frames: list[DataFrame], order: str) -> DataFrame:
    """Inputs in order, under an explicit ordinal ``(input_index, order)``; missing columns are null."""
    out = None
    for i, df in enumerate(frames):
        own = df.withColumn("input_index", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out.withColumn("ordinal", F.struct("input_index", order))


def training_sets(spark: SparkSession, train: str, validation: str | None = None) -> dict[str, DataFrame]:
    """``train`` and, where its file is named, there and not empty, ``validation``: JSON lines, read strictly, in one schema."""
    schema = jsonsource.infer(spark, train)
    out = {"train": jsonsource.read(spark, train, schema)}
    if validation and exists(spark, validation) and any(f.size for f in jsonsource.data_files(validation)):
        out["validation"] = jsonsource.read(spark, validation, schema)
    return out
