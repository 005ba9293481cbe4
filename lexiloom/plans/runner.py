"""Plans as named stages that are done once.

A stage is a function from frames to a frame.  Its key is the digest of its code,
its settings and the digests of its inputs, so a folder ``name-key`` holds what
exactly this stage made of exactly these tables: data, and a manifest with the
digest of the data, written last.  Where that is there, the stage is not run
again.  A changed setting or input gives another key, and so do the stages behind
it, unless what comes out is the same.  A run that was cut short goes on at the
first stage without a complete manifest.

A gate judges a stage's table; one that fails is kept with the reason and raises,
again at each run.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.acquire import shortened
from ..operators.stats import GateError
from ..sources import artifacts, digest
from ..sources.shared import exists, read_text


@dataclass
class Stage:
    """``run(inputs, settings)``; ``inputs`` are names of sources or earlier stages; ``gate(frame)`` gives whether it passes, with facts."""

    name: str
    inputs: tuple[str, ...]
    run: Callable[[dict[str, DataFrame], dict], DataFrame]
    settings: dict = field(default_factory=dict)
    gate: Callable[[DataFrame], tuple[bool, dict]] | None = None
    version: str = ""

    def code(self) -> str:
        """What stands for the stage's code: its version, or the text of its functions."""
        if self.version:
            return self.version
        return "\n".join(inspect.getsource(f) for f in (self.run, self.gate) if f)


@dataclass
class Result:
    """A stage's table, the digest of it, its folder, and whether this run made it."""

    frame: DataFrame
    sha256: str
    folder: str
    fresh: bool
    facts: dict


def run(spark: SparkSession, folder: str, sources: dict[str, DataFrame], stages: list[Stage]) -> dict[str, Result]:
    """Do what is not done yet; the result of each stage by name."""
    names = [*sources, *[s.name for s in stages]]
    if len(set(names)) != len(names):
        raise ValueError("names of sources and stages repeat")
    digests = {name: digest.table_digest(df)["sha256"] for name, df in sources.items()}
    frames, out = dict(sources), {}
    for stage in stages:
        if missing := [n for n in stage.inputs if n not in frames]:
            raise ValueError(f"{stage.name} asks for {missing}, which come later or not at all")
        about = {"stage": stage.name, "code": hashlib.sha256(stage.code().encode()).hexdigest(), "settings": stage.settings, "inputs": {n: digests[n] for n in stage.inputs}}
        out[stage.name] = _one(spark, folder, stage, about, frames)
        frames[stage.name], digests[stage.name] = out[stage.name].frame, out[stage.name].sha256
    return out


def _one(spark: SparkSession, folder: str, stage: Stage, about: dict, frames: dict[str, DataFrame]) -> Result:
    manifest = artifacts.Manifest(about)
    where = f"{folder.rstrip('/')}/{stage.name}-{manifest.input_sha256[:24]}"
    state = json.loads(read_text(spark, f"{where}/manifest.json")) if exists(spark, f"{where}/manifest.json") else {}
    fresh = state.get("status") not in ("complete", "gate_failed")
    if fresh:
        manifest.save(spark, f"{where}/manifest.json").to("running").save(spark, f"{where}/manifest.json")
        try:
            stage.run({n: frames[n] for n in stage.inputs}, dict(stage.settings)).write.mode("overwrite").parquet(f"{where}/data")
            made = spark.read.parquet(f"{where}/data")
            passed, facts = stage.gate(made) if stage.gate else (True, {})
            state = json.loads(manifest.gate(passed, output=digest.table_digest(made), **facts).save(spark, f"{where}/manifest.json").json())
        except Exception as wrong:
            manifest.to("failed", error=shortened(str(wrong))).save(spark, f"{where}/manifest.json")
            raise
    facts = {k: v for k, v in state.items() if k not in ("status", "inputs", "input_sha256", "output")}
    if state["status"] == "gate_failed":
        raise GateError(f"{stage.name} did not pass: {facts}")
    return Result(spark.read.parquet(f"{where}/data"), state["output"]["sha256"], where, fresh, facts)
