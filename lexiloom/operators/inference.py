"""Model calls as a pluggable batch interface: one load for each worker, batches of a stated size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructType

#: A loader gives a function from prompts to (response, tokens, stopped).
Loader = Callable[[], Callable[[list[str]], list[tuple[str, int, bool]]]]


def generate(df: DataFrame, prompt: str, loader: Loader, model: str, batch: int = 16) -> DataFrame:
    """``df`` with ``response, tokens, stopped, model_path``."""
    schema = StructType([*df.schema.fields, *StructType().add("response", "string").add("tokens", IntegerType()).add("stopped", "boolean").add("model_path", "string").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = loader()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch].copy()
                out = answer(list(part[prompt]))
                part["response"], part["tokens"], part["stopped"] = (list(c) for c in zip(*out, strict=True))
                part["model_path"] = model
                yield part

    return df.mapInPandas(run, schema)


def echo(limit: int = 64) -> Callable[[list[str]], list[tuple[str, int, bool]]]:
    """A deterministic stand-in: answers with the prompt's last line."""

    def answer(prompts: list[str]) -> list[tuple[str, int, bool]]:
        lines = [(p or "").rstrip("\n").rpartition("\n")[2] for p in prompts]
        return [(x[:limit], len(x[:limit].split()), len(x) <= limit) for x in lines]

    return answer
