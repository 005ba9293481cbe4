"""File audits, report collection and run manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonsource import file_system
from .shared import qualified, write_text


#: Bytes of a file that a task holds at once.
BUFFER = 8 << 20


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, found`` (SHA-256) of every file under a folder, ``path`` being relative to it.

    Spark lists the files without their contents; executors stream them through
    Arrow's file systems, a buffer at a time, so nothing but digests comes back.
    """
    root = qualified(spark, folder)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(found=[_streamed(p) for p in pdf["path"]])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = listed.repartition(width, "path").mapInPandas(digests, "path string, length long, found string")
    return hashed.withColumn("path", F.ltrim(F.expr(f"substring(path, {len(root) + 1})"), F.lit("/")))


def _streamed(path: str) -> str:
    fs, at = file_system(path)
    digest = hashlib.sha256()
    with fs.open_input_file(at) as stream:
        while piece := stream.read(BUFFER):
            digest.update(piece)
    return digest.hexdigest()


def audit_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """``path, exists, matches, length`` of expected files (``path`` relative to the folder, ``sha256``); a null hash only asks for the file."""
    found = file_digests(spark, folder)
    matches = F.when(F.col("sha256").isNull(), F.col("found").isNotNull()).otherwise(F.coalesce(F.lower("sha256") == F.col("found"), F.lit(False)))
    return expected.join(found, "path", "left").select("path", F.col("found").isNotNull().alias("exists"), matches.alias("matches"), "length")


#: Fixed value: the file of a resource folder that its model hash is of.
MODEL_FILE = "model.safetensors"


def audit_resources(spark: SparkSession, folder: str, resources: DataFrame) -> DataFrame:
    """``name, path, exists, hash_matches, model_hash_matches`` of ``name, path, sha256, model_sha256``.

    A resource is a file or a folder under ``folder``; a hash that is not given,
    or whose file is not there, leaves null.
    """
    found = file_digests(spark, folder).select(F.col("path").alias("file"), "found")
    whole = found.select(F.col("file").alias("path"), F.col("found").alias("own"))
    model = found.where(F.col("file").endswith(f"/{MODEL_FILE}")).select(F.regexp_replace("file", "/[^/]*$", "").alias("path"), F.col("found").alias("model"))
    folders = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("file", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("file", "/"), F.lit(1), n), "/"))).alias("path")).distinct().withColumn("inside", F.lit(True))
    met = resources.join(whole, "path", "left").join(model, "path", "left").join(folders, "path", "left")
    fits = lambda want, got: F.when(F.col(want).isNotNull() & F.col(got).isNotNull(), F.lower(want) == F.col(got))
    return met.select("name", "path", (F.col("own").isNotNull() | F.coalesce("inside", F.lit(False))).alias("exists"), fits("sha256", "own").alias("hash_matches"), fits("model_sha256", "model").alias("model_hash_matches"))


def collect_reports(spark: SparkSession, root: str, needed: list[str]) -> DataFrame:
    """JSON documents under ``root`` that have all needed fields, with their path; none are invented."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("wholetext", True).text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    has = [F.get_json_object("value", f"$.{n}").isNotNull() for n in needed]
    out = raw.where(F.col("path").endswith(".json"))
    for h in has:
        out = out.where(h)
    return out.select("path", *(F.get_json_object("value", f"$.{n}").alias(n) for n in needed), F.col("value").alias("document")).orderBy("path")


@dataclass
class Manifest:
    """Run state with checked transitions, kept as JSON text by the caller.

    A gate ends a run: ``gate(passed)`` completes it or marks the gate's failure.
    """

    inputs: dict
    status: str = "loading"
    facts: dict = field(default_factory=dict)
    #: What may follow what.
    NEXT = {"loading": ("running", "failed"), "running": ("complete", "gate_failed", "failed")}

    def to(self, status: str, **facts) -> Manifest:
        if status not in self.NEXT.get(self.status, ()):
            raise ValueError(f"{self.status} cannot become {status}")
        self.status = status
        self.facts |= facts
        return self

    def gate(self, passed: bool, **facts) -> Manifest:
        return self.to("complete" if passed else "gate_failed", **facts)

    @property
    def input_sha256(self) -> str:
        """Hash of the inputs as canonical JSON: equal inputs, equal runs."""
        return hashlib.sha256(json.dumps(self.inputs, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def save(self, spark: SparkSession, path: str) -> Manifest:
        """Write the state to a file, over an older one."""
        write_text(spark, path, self.json())
        return self

    def json(self) -> str:
        return json.dumps({"status": self.status, "inputs": self.inputs, "input_sha256": self.input_sha256, **self.facts}, ensure_ascii=False, sort_keys=True)


def save_run_metadata(spark: SparkSession, folder: str, config: dict, model: str, status: str, metrics: dict | None = None, environment: dict | None = None) -> str:
    """``run_metadata.json`` of a training run: status, model, configuration, metrics and what it ran on; its path."""
    where = f"{folder.rstrip('/')}/run_metadata.json"
    payload = {"status": status, "model_name_or_path": model, "config": config, "metrics": metrics or {}, "environment": environment or {"spark": spark.version, "master": spark.sparkContext.master}}
    write_text(spark, where, json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True, default=str))
    return where


def upsert_block(document: str, name: str, block: str) -> str:
    """Replace the text between the block's markers, or append it with markers."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    if start in document and end in document:
        head, _, rest = document.partition(start)
        return f"{head}{start}\n{block}\n{end}{rest.partition(end)[2]}"
    return f"{document.rstrip()}\n\n{start}\n{block}\n{end}\n"
