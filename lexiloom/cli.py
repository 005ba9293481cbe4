"""Command line: each command reads JSON lines or Parquet, writes JSON lines, and prints its report as JSON."""

from __future__ import annotations

import argparse
import importlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chat, inference, ngram_model, preferences, review, sft, stats, teacher, tokens
from .operators.acquire import acquire, column
from .operators.sampling import ordinals
from .plans import corpus, judge_run, session
from .sources import artifacts, jsonl, jsonsource, registry
from .sources.shared import durable

SEED = corpus.SEED
#: Characters that are packed together.
PACKED = 32 << 20


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else jsonsource.read(spark, path, jsonsource.infer(spark, path))


def _config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError("the configuration's root must be a mapping")
    return value


def _named(name: str):
    """An object by ``module:name``, such as a model loader or a tokenizer."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # small reports only


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexiloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, seed: bool = True):
        p = sub.add_parser(name)
        for flag, options in args:
            p.add_argument(flag, **options)
        if seed:
            p.add_argument("--seed", type=int, default=SEED)

    need = lambda **k: {"required": True, **k}
    command("doctor", seed=False)
    command("audit-resources", ("--folder", need()), ("--expected", need()), seed=False)
    command("acquire", ("--config", need()), ("--output", need()), ("--max-documents", {"type": int}))
    command("inspect-hf", ("--config", need()), ("--source", need()), seed=False)
    command("prepare", ("--input", need(nargs="+")), ("--output", need()))
    command("mix", ("--input", need()), ("--output", need()), ("--fractions", need(help="category=share,...")), ("--total-tokens", need(type=int)), ("--tokenizer", {"help": "module:name of a function that gives (encode, decode)"}))
    command("build-sft", ("--input", need(nargs="+")), ("--output", need()), ("--quotas", {"help": "task=rows,..."}))
    loader = ("--loader", {"help": "module:name of a function that gives a model's answer function; without it a stub that echoes"})
    command("synthesize-sft", ("--input", need()), ("--output", need()), ("--limit", {"type": int, "default": 200}), loader)
    command("build-preferences", ("--input", need()), ("--output", need()), ("--limit", {"type": int, "default": 20_000}))
    command("build-eval", ("--input", need()), ("--output", need()), ("--per-task", {"type": int, "default": 100}))
    command("build-general-eval", ("--input", need()), ("--output", need()), ("--per-category", {"type": int, "default": 200}))
    command("train", ("stage", {"choices": ["cpt", "sft", "reward", "dpo", "grpo"]}), ("--input", need()), ("--output", need()), seed=False)
    command("generate", ("--input", need()), ("--output", need()), ("--max-new-tokens", {"type": int, "default": 384}), loader, ("--model", {"default": "stub"}), seed=False)
    command("judge", ("--input", need(help="presentations")), ("--output", need()), loader, ("--model", {"default": "stub"}), ("--min-consistency", {"type": float, "default": stats.CONSISTENCY}), seed=False)
    command("score", ("--input", need()), ("--output", need()), seed=False)
    command("blind-review", ("--input", need(nargs="+", help="model=path")), ("--output", need()))
    command("summarize-review", ("--review", need()), ("--key", need()), seed=False)
    command("perplexity", ("--input", need()), ("--max-length", {"type": int, "default": 1024}), ("--train", {"help": "texts to fit an n-gram model on, where the input has no loss"}), ("--order", {"type": int, "default": ngram_model.ORDER}), seed=False)
    command("report", ("--root", need()), ("--fields", {"default": "status,metrics"}), seed=False)
    return top


def _pairs(text: str, kind) -> dict:
    return {k: kind(v) for k, v in (x.split("=", 1) for x in text.split(","))}


def _union(spark: SparkSession, paths: list[str]) -> DataFrame:
    frames = [_read(spark, p).withColumn("__row", F.monotonically_increasing_id()) for p in paths]
    return registry.union_inputs(frames, "__row").drop("__row", "input_index")


def _messages(df: DataFrame):
    return F.from_json(F.to_json("messages"), chat.MESSAGES)


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Run one command and return its report."""
    if a.command == "doctor":
        return session.doctor(spark)
    if a.command == "audit-resources":
        expected = _read(spark, a.expected)
        audit = artifacts.audit_resources if "name" in expected.columns else artifacts.audit_files
        if audit is artifacts.audit_resources:
            expected = expected.select("name", "path", column(expected, "sha256").alias("sha256"), column(expected, "model_sha256").alias("model_sha256"))
        return {"files": _rows(audit(spark, a.folder, expected))}
    if a.command == "acquire":
        sources = registry.parse(_config(a.config))
        for s in sources:
            s.max_documents = a.max_documents or s.max_documents
        frames, report = acquire(spark, sources, lambda s: registry.numbered(spark, s, "__n"), "__n", a.seed)
        for name, df in frames.items():
            jsonl.write(df, os.path.join(a.output, name))
        return {"sources": _rows(report)}
    if a.command == "inspect-hf":
        source = next(s for s in registry.parse(_config(a.config)) if s.name == a.source)
        return {"fields": _rows(registry.inspect(registry.load(spark, source)))}
    if a.command == "prepare":
        done = corpus.prepare(_union(spark, a.input), "ordinal", a.seed).persist()
        rows = jsonl.write(done.where(F.size("reasons") == 0).drop("reasons", "ordinal"), a.output, ["split"])
        return {"kept": rows, "audit": _rows(corpus.audit(done, "source" if "source" in done.columns else "category"))}
    if a.command == "mix":
        tokenizer = tokens.library_tokenizer(_named(a.tokenizer)) if a.tokenizer else tokens.SIMPLE
        mixed, _ = durable(corpus.mixture(_read(spark, a.input), _pairs(a.fractions, float), a.total_tokens, a.seed, tokenizer=tokenizer), "mixture")
        return {"rows": jsonl.write(mixed, a.output), "achieved": _rows(tokens.mixture_manifest(mixed))}
    if a.command == "build-sft":
        rows = sft.build(_union(spark, a.input), "ordinal", a.seed, _pairs(a.quotas, int) if a.quotas else None)
        return {"rows": jsonl.write(rows, a.output, ["split"])}
    if a.command == "synthesize-sft":
        asked = teacher.passages(_read(spark, a.input), "source_id", a.limit, a.seed)
        answered = inference.generate(asked, "prompt", _named(a.loader) if a.loader else inference.echo, a.loader or "stub")
        audited = answered.withColumn("rejection_reasons", teacher.rejections(F.col("task"), F.col("response"), F.col("passage"))).withColumn("accepted_by_rules", F.size("rejection_reasons") == 0).withColumn("requires_human_review", F.lit(True))
        audited, _ = durable(audited, "answers")
        accepted = audited.where("accepted_by_rules").select("task", "source_id", F.col("prompt").alias("input"), F.col("response").alias("output"), F.lit("teacher").alias("source"))
        return {"rows": jsonl.write(audited, os.path.join(a.output, "audit")), "accepted": jsonl.write(accepted, os.path.join(a.output, "accepted"))}
    if a.command == "build-preferences":
        rows = _read(spark, a.input)
        pairs = preferences.build(rows.withColumn("messages", _messages(rows)), a.seed, a.limit).persist()
        return {"rows": jsonl.write(pairs, a.output, ["split"]), "errors": _rows(preferences.error_counts(pairs))}
    if a.command == "build-eval":
        rows = _read(spark, a.input)
        rows = rows.withColumn("messages", _messages(rows)) if "messages" in rows.columns else rows
        return {"rows": jsonl.write(corpus.domain_evaluation(rows, a.per_task, a.seed), a.output)}
    if a.command == "build-general-eval":
        return {"rows": jsonl.write(corpus.perplexity_sets(_read(spark, a.input), a.per_category, a.seed), a.output)}
    if a.command == "train":
        return {"stage": a.stage, "rows": jsonl.write(training_table(_read(spark, a.input), a.stage), a.output)}
    if a.command == "generate":
        rows = _read(spark, a.input)
        prompt = chat.prompt_text(_messages(rows)) if "messages" in rows.columns else T.truthy(*(F.col(c) for c in ("prompt", "input", "text") if c in rows.columns))
        limit = a.max_new_tokens
        return {"rows": jsonl.write(inference.generate(rows.withColumn("__prompt", prompt), "__prompt", _named(a.loader) if a.loader else lambda: inference.echo(limit), a.model).drop("__prompt"), a.output)}
    if a.command == "judge":
        return judge_run.pairwise(spark, _read(spark, a.input), a.output, _named(a.loader) if a.loader else inference.echo, a.model, a.min_consistency)
    if a.command == "score":
        rows = _read(spark, a.input)
        reference = chat.reference_text(_messages(rows) if "messages" in rows.columns else F.array().cast(chat.MESSAGES), *(F.col(c) for c in ("reference", "answer", "output") if c in rows.columns))
        scored = corpus.score_generations(rows, F.col("response"), reference).persist()
        return {"rows": jsonl.write(scored, a.output), "summary": _rows(review.score_summary(scored, ["chrf", "repetition", "length", "exact"]))}
    if a.command == "blind-review":
        parts = [_read(spark, p).select("id", "task", "prompt", "response", "reference").withColumn("model", F.lit(m)) for m, p in (x.split("=", 1) for x in a.input)]
        together = parts[0]
        for p in parts[1:]:
            together = together.unionByName(p)
        sheet, key = review.blind(together, a.seed, review.DIMENSIONS)
        return {"rows": jsonl.write(sheet, os.path.join(a.output, "sheet")), "key": jsonl.write(key, os.path.join(a.output, "key"))}
    if a.command == "summarize-review":
        sheet = _read(spark, a.review)
        sheet = sheet.withColumn("scores", F.from_json(F.to_json("scores", {"ignoreNullFields": "false"}), "map<string,int>"))
        return {"models": _rows(review.review_summary(sheet, _read(spark, a.key)))}
    if a.command == "perplexity" and a.train:
        split = lambda path: _read(spark, path).where(T.nonblank(F.col("text"))).select(tokens.simple_tokens(F.col("text")).alias("tokens"))
        by_row = ngram_model.perplexity(ngram_model.fit(split(a.train), "tokens", a.order), ordinals(split(a.input), "row"), "tokens", "row")
        whole = by_row.agg(F.sum("n_tokens").alias("predicted_tokens"), F.exp(-F.sum("log_prob") / F.sum("n_tokens")).alias("perplexity"))
        return {"perplexity": _rows(whole)}
    if a.command == "perplexity":
        rows = _read(spark, a.input)
        pieces = tokens.chunk(rows.where(T.nonblank(F.col("text"))).withColumn("tokens", tokens.simple_tokens(F.col("text"))).withColumn("__id", F.xxhash64("text")), "tokens", "__id", a.max_length)
        return {"perplexity": _rows(tokens.perplexity(pieces, F.col("loss")))} if "loss" in rows.columns else {"predicted_tokens": _rows(pieces.where(F.size("tokens") >= 2).agg(F.sum(F.size("tokens") - 1).alias("tokens")))}
    return {"reports": _rows(artifacts.collect_reports(spark, a.root, a.fields.split(",")).drop("document"))}


def training_table(df: DataFrame, stage: str) -> DataFrame:
    """The table that a training stage consumes; training itself is out of scope."""
    if stage == "cpt":
        size = df.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
        groups = max(1, -(-size // PACKED))
        rows = df.withColumn("tokens", tokens.simple_tokens(F.col("text"))).withColumn("__g", F.pmod(F.xxhash64("text"), F.lit(groups))).withColumn("__o", F.sha2("text", 256))
        return tokens.pack_blocks(rows, "tokens", "__o", 1024, "__g")
    if stage == "sft":
        if "messages" in df.columns:
            prompt, completion = chat.prompt_and_completion(_messages(df))
            return df.select(prompt.alias("prompt"), completion.alias("completion"))
        return df.select(F.col("prompt_text").alias("prompt"), F.col("answer_text").alias("completion"))
    if stage in ("reward", "dpo"):
        return df.select("prompt", "chosen", "rejected")
    wanted = ("prompt", "reference", "task", "source_text", "answer_text", "source_id")
    # nothing else passes, so no answer can leak into the prompt
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted))


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    print(json.dumps(run(session.build(), a), ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
