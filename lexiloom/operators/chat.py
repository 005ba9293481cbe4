"""Message lists: templates, prompts without the gold answer, references, training projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import truthy

MESSAGES = "array<struct<role:string,content:string>>"
#: Markers of the default chat layout and end tokens that may replace the assistant's.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT_ENDS = ("<|im_end|>", "<|endoftext|>")
DEFAULT_SYSTEM = "You are a helpful assistant."


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render(messages: Column, header: bool = False, assistant_end: str = END, default_system: str | None = None) -> Column:
    """All messages in the default layout; ``header`` opens an assistant turn, ``assistant_end`` closes only those."""
    if assistant_end not in ASSISTANT_ENDS:
        raise ValueError(f"the assistant's end token must be one of {ASSISTANT_ENDS}")
    if default_system is not None:
        first = F.coalesce(F.get(messages, F.lit(0))["role"], F.lit(""))
        messages = F.when(first == "system", messages).otherwise(F.concat(F.array(message("system", F.lit(default_system))), messages))
    one = lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.when(m["role"] == "assistant", assistant_end).otherwise(END), F.lit("\n"))
    body = F.array_join(F.transform(messages, one), "")
    return F.concat(body, F.lit(f"{START}assistant\n")) if header else body


def without_answer(messages: Column) -> Column:
    """Messages up to the last one that is not the assistant's."""
    last = F.aggregate(F.transform(messages, lambda m, i: F.when(m["role"] != "assistant", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(messages, F.lit(1), last)


def last_of(messages: Column, role: str) -> Column:
    """Content of the last message of a role; null if there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def prompt_text(messages: Column, header: bool = True) -> Column:
    """The generation prompt: never holds the gold answer."""
    return render(without_answer(messages), header=header)


def reference_text(messages: Column, *fields: Column) -> Column:
    """The first field that is not empty, else the last assistant message, else ''."""
    return F.coalesce(truthy(*fields, last_of(messages, "assistant")) if fields else last_of(messages, "assistant"), F.lit(""))


def completion_text(messages: Column) -> Column:
    """Content of the last message."""
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))


def prompt_and_completion(messages: Column) -> tuple[Column, Column]:
    """All but the last message, and the last."""
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0))), F.slice(messages, F.size(messages), F.lit(1))


def plain_prompt(kind: str, text: Column) -> Column:
    """Plain layouts for models without a chat template."""
    layouts = {"translation": ("原文：", "\n译文："), "question": ("问题：", "\n回答：")}
    before, after = layouts[kind]
    return F.concat(F.lit(before), text, F.lit(after))


def payload_errors(messages: Column, max_tokens: Column, most: int = 41) -> Column:
    """What is wrong with a chat request; empty if nothing is."""
    last = F.try_element_at(messages, F.lit(-1))["role"]
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(F.size(messages).between(1, most), F.lit(False)), "messages"),
            F.when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)) | m["content"].isNull()), "roles"),
            F.when(~F.coalesce(last == "user", F.lit(False)), "last_role"),
            F.when(~F.coalesce(max_tokens.between(32, 512), F.lit(False)), "max_tokens"),
        )
    )
