"""Chat requests as rows: checked, routed, prompted and answered, in batches or from a stream.

Defined cases: a request with anything wrong gets its errors and no route; null
messages are wrong; texts are never cut, a prompt beyond the limit is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat, inference
from ..operators.tokens import simple_tokens

# The name that routes by content, where it leads, and the longest prompt in tokens.
AUTO, TRANSLATE, GENERAL, LONGEST = "smart_repaired", "translation_repaired", "official_instruct", 2048


def routed(requests: DataFrame, models: list[str], translators: tuple[str, ...] = (TRANSLATE,), encode=simple_tokens, longest: int = LONGEST) -> DataFrame:
    """``requests`` (``model, messages, max_tokens``) with ``errors``, and for those without any ``backend`` and ``prompt``.

    Translators get what the last message wants translated in the plain layout,
    others the whole conversation.
    """
    last = F.try_element_at(F.col("messages"), F.lit(-1))["content"]
    known = F.coalesce(F.col("model").isin(*models, AUTO), F.lit(False))
    wrong = F.concat(F.when(known, F.array().cast("array<string>")).otherwise(F.array(F.lit("model"))), F.coalesce(chat.payload_errors(F.col("messages"), F.col("max_tokens")), F.array(F.lit("messages"))))
    backend = T.route(F.col("model"), last, AUTO, TRANSLATE, GENERAL)
    checked = requests.withColumn("errors", wrong).withColumn("backend", F.when(F.size("errors") == 0, backend))
    plain = chat.plain_prompt("translation", T.translation_source(last))
    prompt = F.when(F.col("backend").isin(*translators), plain).when(F.col("backend").isNotNull(), chat.render(F.col("messages"), header=True))
    long = F.coalesce(F.size(encode(prompt)) > longest, F.lit(False))
    out = checked.withColumn("prompt", prompt).withColumn("errors", F.when(long, F.array(F.lit("prompt_too_long"))).otherwise(F.col("errors")))
    empty = F.size("errors") == 0
    return out.withColumn("backend", F.when(empty, F.col("backend"))).withColumn("prompt", F.when(empty, F.col("prompt")))


def replies(requests: DataFrame, loaders: dict[str, inference.Loader]) -> DataFrame:
    """The routed requests with ``response, tokens, hit_limit``; every backend loads once for each task that has its requests."""
    ready = routed(requests, list(loaders))
    none: list[Column] = [F.lit(None).cast(t).alias(n) for n, t in (("response", "string"), ("tokens", "int"), ("hit_limit", "boolean"))]
    out = ready.where(F.size("errors") > 0).select("*", *none)
    for name, loader in loaders.items():
        said = inference.generate(ready.where(F.col("backend") == name), "prompt", loader, name)
        out = out.unionByName(said.withColumn("hit_limit", F.col("tokens") >= F.col("max_tokens")).drop("stopped", "model_path"))
    return out
