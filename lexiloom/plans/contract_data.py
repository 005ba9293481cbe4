"""More registered queries: sources and sinks, digests, lossless mixtures, judge runs, streaming and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality
from ..functions import text as T
from ..operators import chat, judging, ngram_model, preferences, reward_model, stats, teacher, tokens
from ..operators.acquire import Source, acquire, alias
from ..sources import digest, journal, jsonl, jsonsource, registry
from ..sources.shared import new_path
from . import corpus, experiments, judge_run, repair, serving
from ..streaming import ingest
from .contract import _BLIND, _KEY, _OPTIONS, _PAIRS, _REASONED, _REP, _SPLIT, SEED, _chats, _docs, _generations, _pairs, _preferences, _read, _shown, query
from .contract import _CHATS as _CHATS_SQL
from .contract_rules import _STRIPPED

# --- JSON lines -----------------------------------------------------------------


def _lines(spark, sf_dir) -> str:
    """``documents`` as JSON lines, every seventh an array."""
    docs = _read(spark, sf_dir, "documents")
    line = F.to_json(F.struct("doc_id", "lang", "text", "n_chars"), {"ignoreNullFields": "false"})
    path = new_path(spark, "lines")
    docs.select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)).write.text(path)
    return path


@query("SELECT doc_id, n_chars, sha256(text) AS text_sha256 FROM documents WHERE doc_id % 7 <> 0 AND lang IN ('en', 'de') AND n_chars > 500")
def jsonl_scan(spark, sf_dir):
    rows = jsonsource.read(spark, _lines(spark, sf_dir), "doc_id long, lang string, text string, n_chars long, _error string")
    return rows.where("_error is null and lang in ('en', 'de') and n_chars > 500").select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN 'a JSON list, not an object' ELSE 'row' END AS what, count(*) AS lines FROM documents GROUP BY 1")
def jsonl_bad_lines(spark, sf_dir):
    rows = jsonsource.read(spark, _lines(spark, sf_dir), "doc_id long, _error string")
    return rows.groupBy(F.coalesce("_error", F.lit("row")).alias("what")).agg(F.count("*").alias("lines"))


def _acquired(spark, sf_dir, mode: str, columns: list, most: int | None = None, **more):
    """``documents`` staged as JSON lines in order of their ids, and acquired from there."""
    path = new_path(spark, "staged")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = _read(spark, sf_dir, "documents").repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id")
    jsonl.write(docs.select(*columns), f"{path}/v1")
    source = Source("docs", "json", path, "general", mode=mode, max_documents=most, revision="v1", **more)
    frames, report = acquire(spark, [source], lambda s: registry.numbered(spark, s, "__n"), "__n", SEED)
    if (wrong := report.first()["error"]) is not None:
        raise ValueError(wrong)
    return frames["docs"]


_ORDINAL = "row_number() OVER (ORDER BY doc_id) - 1"
_ACQUIRED = f"o AS (SELECT *, {_ORDINAL} AS n FROM documents)"
_WORK_SPLIT = _SPLIT.format(f"""sha256('{SEED}:' || CASE WHEN coalesce(source, '') <> '' THEN 'work:' || source ELSE 'source_id:docs:' || n END)""")


@query(f"""WITH {_ACQUIRED} SELECT 'docs:' || n AS id, 'docs:' || n AS source_id, 'general' AS category, source AS work, doc_id, {_WORK_SPLIT} AS split, sha256(text) AS text_sha256, lang AS metadata_lang
    FROM o WHERE {_STRIPPED.format("text")} <> ''""")
def acquire_corpus(spark, sf_dir):
    rows = _acquired(spark, sf_dir, "corpus", ["doc_id", "text", "lang", "source", "n_chars"])
    return rows.select("id", "source_id", "category", "work", "doc_id", "split", F.sha2("text", 256).alias("text_sha256"), F.col("metadata")["lang"].alias("metadata_lang"))


@query(f"WITH {_ACQUIRED} SELECT 'docs:' || n AS id, doc_id FROM o WHERE n < 100 AND {_STRIPPED.format('text')} <> ''")
def acquire_bounded(spark, sf_dir):
    return _acquired(spark, sf_dir, "corpus", ["doc_id", "text"], most=100).select("id", "doc_id")


_ALIAS = "CASE ['c2m', 'm2c', 'punctuate', 'creation'][CAST(doc_id % 4 + 1 AS INT)] WHEN 'c2m' THEN 'old_to_modern' WHEN 'm2c' THEN 'modern_to_old' WHEN 'punctuate' THEN 'punctuation' ELSE 'creation' END"


@query(f"""WITH {_ACQUIRED}, t AS (SELECT *, {_ALIAS} AS task FROM o)
    SELECT 'docs:' || n AS id, task, CASE task WHEN 'old_to_modern' THEN lang WHEN 'modern_to_old' THEN text END AS classical, CASE task WHEN 'old_to_modern' THEN text WHEN 'modern_to_old' THEN lang END AS modern,
           sha256(CASE task WHEN 'punctuation' THEN text ELSE lang || chr(10) || text END) AS text_sha256 FROM t WHERE task <> 'punctuation' OR {_STRIPPED.format("text")} <> ''""")
def acquire_instructions(spark, sf_dir):
    task = F.element_at(F.array(*map(F.lit, ("c2m", "m2c", "punctuate", "creation"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _acquired(spark, sf_dir, "instruction", [task.alias("task"), F.col("lang").alias("input"), F.col("text").alias("output")])
    return rows.select("id", "task", "classical", "modern", F.sha2("text", 256).alias("text_sha256"))


_CLASSIFIED = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'modern_to_old' WHEN 1 THEN 'old_to_modern' WHEN 2 THEN 'creation' WHEN 3 THEN 'appreciation' END"


@query(f"""WITH {_ACQUIRED}, t AS (SELECT *, {_CLASSIFIED} AS task, [' 请译成文言 ', '翻译成白话', '试作诗', '赏析', '问'][CAST(doc_id % 5 + 1 AS INT)] AS asked FROM o)
    SELECT 'docs:' || n AS id, task, {_STRIPPED.format("asked")} || chr(10) || source AS input, sha256({_STRIPPED.format("text")}) AS output_sha256 FROM t WHERE task IS NOT NULL AND {_STRIPPED.format("text")} <> ''""")
def acquire_generic(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, (" 请译成文言 ", "翻译成白话", "试作诗", "赏析", "问"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _acquired(spark, sf_dir, "generic_sft", [asked.alias("instruction"), F.col("source").alias("input"), F.col("text").alias("output")])
    return rows.select("id", "task", "input", F.sha2("output", 256).alias("output_sha256"))


# --- runs and digests -------------------------------------------------------------


@query("SELECT doc_id, upper(lang) || ':' || n_chars AS answer FROM documents")
def journal_resume(spark, sf_dir):
    """A run over the even documents, and the same run over all, which does the rest."""
    docs, path = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), new_path(spark, "journal")
    answer = lambda d: d.select("doc_id", F.concat(F.upper("lang"), F.lit(":"), F.col("n_chars").cast("string")).alias("answer"))
    first = journal.run_pending(docs.where("doc_id % 2 = 0"), path, "doc_id", answer, 4096)
    second = journal.run_pending(docs, path, "doc_id", answer, 4096)
    if first + second != docs.count():
        raise ValueError("a task ran twice")
    return journal.committed(spark, path, "doc_id long, answer string", "doc_id")


def _canonical(*names: str) -> str:
    return " || ".join(f"'{len(n)}:{n}=' || CASE WHEN {n} IS NULL THEN 'n' ELSE 's' || octet_length(encode({n}::VARCHAR)) || ':' || {n}::VARCHAR END" for n in sorted(names))


_PARTS = ", ".join(f"sum(CAST('0x' || substr(f, {1 + 8 * k}, 8) AS BIGINT)) AS s{k}" for k in range(8))
_CHILDREN = "SELECT substr(prefix, 1, {0}) AS prefix, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(prefix || '=' || digest, ';' ORDER BY prefix)) AS digest FROM {1} GROUP BY 1"


@query(f"""WITH f AS (SELECT sha256({_canonical("doc_id", "lang", "n_chars", "source", "text")}) AS f FROM documents),
    s AS (SELECT substr(f, 1, 2) AS prefix, count(*) AS rows, {_PARTS} FROM f GROUP BY 1),
    two AS (SELECT prefix, rows, sha256(concat_ws(':', rows, s0, s1, s2, s3, s4, s5, s6, s7)) AS digest FROM s), one AS ({_CHILDREN.format(1, "two")}), root AS ({_CHILDREN.format(0, "one")})
    SELECT * FROM two UNION ALL SELECT * FROM one UNION ALL SELECT * FROM root""")
def digest_tree(spark, sf_dir):
    return digest.tree(_read(spark, sf_dir, "documents").select("text", "doc_id", "lang", "source", "n_chars"), 2)


@query("""SELECT doc_id, unnest([1, 0])::BIGINT AS in_first, unnest([0, 1])::BIGINT AS in_second FROM documents WHERE doc_id % 50 = 0 AND text <> upper(text)
    UNION ALL SELECT doc_id, 1, 2 FROM documents WHERE doc_id % 50 = 1""")
def table_difference(spark, sf_dir):
    """``documents`` against a copy with some texts changed and some rows twice."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.upper("text")).otherwise(F.col("text"))).unionByName(docs.where("doc_id % 50 = 1"))
    return digest.differing_rows(docs, changed).select(F.get_json_object("row", "$.doc_id").cast("long").alias("doc_id"), "in_first", "in_second")


_FOUR = "4 * (length({0}) % 5) + 2 * (length({0}) % 5) + length({0}) % 3 - 4 * (length({0}) % 3)"
_INDEPENDENT = f"""{_PAIRS}, o AS (SELECT *, unnest([0, 1]) AS ord, CAST(('0x' || right(sha256('{SEED}:' || id), 1)) AS INT) % 2 = 0 AS first FROM pairs),
    u AS (SELECT 'all:' || id || ':' || ord AS presentation_id, (first = (ord = 0)) AS a_is_chosen, {_FOUR.format("response")} AS c, {_FOUR.format("prompt")} AS r, length(response) % 11 = 0 OR length(prompt) % 11 = 0 AS bad FROM o)"""


@query(f"""WITH {_INDEPENDENT} SELECT presentation_id, CASE WHEN bad THEN 'INVALID' WHEN abs(c - r) <= 1 THEN 'TIE' WHEN (c > r) = a_is_chosen THEN 'A' ELSE 'B' END AS winner FROM u""")
def judge_independent(spark, sf_dir):
    """Independent scores of both candidates, as pairwise judgments; the stub judge scores lengths and leaves some out."""
    shown = _shown(spark, sf_dir)
    sides = shown.where("order = 0").select(F.col("pair_id").alias("id"), *[F.when(F.col("option_a_role") == r, F.col("option_a")).otherwise(F.col("option_b")).alias(r) for r in ("chosen", "rejected")])
    n = F.length("answer")
    said = F.to_json(F.struct((n % 5).alias("faithfulness"), (n % 5).alias("completeness"), (n % 3).alias("fluency"), (n % 3).alias("hallucination")))
    answers = judging.independent_tasks(sides).select("pair_id", "protocol", "role", F.when(n % 11 != 0, said).otherwise("none").alias("response"))
    return judge_run.independent_judgments(answers, sides, shown).select("presentation_id", F.col("judge.winner").alias("winner"))


# --- lossless mixtures ---------------------------------------------------------------

_PIECES = r"regexp_extract_all({0}, '\s*(?:[A-Za-z0-9]+|[^A-Za-z0-9\s])(?:\s+\z)?')"


@query(f"""WITH p AS (SELECT doc_id, text, {_PIECES.format("text")} AS p FROM documents)
    SELECT doc_id, CAST((len(p) + 255) // 256 AS BIGINT) AS chunks, sha256(text) AS text_sha256, CAST(length(text) AS BIGINT) AS chars FROM p WHERE len(p) > 0""")
def chunk_texts(spark, sf_dir):
    """Chunks of every document, laid end to end again by their offsets."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = tokens.chunk(docs.withColumn("tokens", tokens.SIMPLE.encode(F.col("text"))).withColumn("pieces", tokens.SIMPLE.pieces(F.col("text"))), "tokens", "doc_id", 256, "pieces")
    whole = cut.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sort_array(F.collect_list(F.struct("text_start", "text_end", F.array_join("pieces", "").alias("t")))).alias("c"))
    fits = F.forall(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get(F.col("c"), i)["text_start"] == F.get(F.col("c"), i - 1)["text_end"]) | (F.size("c") == 1)
    text = F.when(fits, F.array_join("c.t", ""))
    return whole.select("doc_id", "chunks", F.sha2(text, 256).alias("text_sha256"), F.array_max("c.text_end").cast("long").alias("chars"))


_QUOTAS = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
_QUOTA = " ".join(f"WHEN '{c}' THEN {round(20_000 * f)}" for c, f in _QUOTAS.items())


@query(f"""WITH d AS (SELECT *, {_PIECES.format("text")} AS p FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')),
    c AS (SELECT doc_id, lang, source, text, p, unnest(range(0, CAST((len(p) + 255) // 256 AS BIGINT))) AS i FROM d), k AS (SELECT *, p[i * 256 + 1:i * 256 + 256] AS piece FROM c),
    e AS (SELECT *, len(piece) + 1 AS n, unnest([0, 1]) AS ep, source || '#' || doc_id || '#' || sha256(text) || '#' || i AS key FROM k),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY ep, sha256('{SEED}:' || ep || ':' || key), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CASE lang {_QUOTA} END AS quota FROM e)
    SELECT lang AS category, doc_id AS id, source AS parent_source_id, CAST(i AS INT) AS chunk_index, ep AS mixture_epoch, CAST(least(n, quota - before) AS BIGINT) AS token_count,
           sha256(array_to_string(piece[1:CAST(least(n, quota - before) AS BIGINT) - 1], '')) AS text_sha256 FROM r WHERE before < quota""")
def mixture_shared_parents(spark, sf_dir):
    """A mixture of documents that share their parent (the source): quotas are met exactly, and texts are slices."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("lang").alias("category"), "text")
    out = corpus.mixture(docs, _QUOTAS, 20_000, SEED, most=256)
    return out.select("category", "id", "parent_source_id", "chunk_index", "mixture_epoch", "token_count", F.sha2("text", 256).alias("text_sha256"))


# --- streaming and fitted models --------------------------------------------------------


@query(f"WITH {_REASONED} SELECT sha256({_KEY}) AS content_hash, count(*) AS times FROM s WHERE len(reasons) = 0 GROUP BY 1")
def stream_first_seen(spark, sf_dir):
    """``documents`` arriving in eight files, two a batch: what the stream kept, with how often it came."""
    staged, table = new_path(spark, "arrivals"), new_path(spark, "ingested")
    docs = _docs(spark, sf_dir).select("doc_id", "text", "category")
    docs.repartition(8, "doc_id").write.parquet(staged)
    ingest.start(spark, staged, docs.schema, table, new_path(spark, "checkpoint"), files=2).awaitTermination()
    came = quality.accepted(corpus.normalized(docs)).groupBy(F.sha2(T.dedup_key(F.col("text")), 256).alias("content_hash")).agg(F.count("*").alias("times"))
    return spark.read.parquet(table).select("content_hash").join(came, "content_hash", "left")


_TOKENS_OF = "regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')"


@query(f"""WITH d AS (SELECT doc_id, list_concat(['\x02'], {_TOKENS_OF}, ['\x03']) AS t FROM documents), g AS (SELECT doc_id, unnest(t[1:len(t) - 1]) AS a, unnest(t[2:]) AS b FROM d),
    c2 AS (SELECT a, b, count(*) AS c FROM g WHERE doc_id % 10 <> 0 GROUP BY ALL), c1 AS (SELECT b, count(*) AS c FROM c2 GROUP BY b), t1 AS (SELECT sum(c) AS total, count(*) AS types FROM c1),
    p1 AS (SELECT b, greatest(c - 0.75, 0)::DOUBLE / total + 0.75::DOUBLE * types / total / (types + 1) AS p FROM c1, t1), h AS (SELECT a, sum(c) AS total, 0.75::DOUBLE * count(*) / sum(c) AS w FROM c2 GROUP BY a),
    p2 AS (SELECT a, b, greatest(c - 0.75, 0)::DOUBLE / total + w * p AS p FROM c2 JOIN h USING (a) JOIN p1 USING (b)),
    e AS (SELECT doc_id, ln(coalesce(p2.p, coalesce(w, 1) * coalesce(p1.p, (SELECT 0.75::DOUBLE * types / total / (types + 1) FROM t1)))) AS l
          FROM g LEFT JOIN p2 USING (a, b) LEFT JOIN h USING (a) LEFT JOIN p1 USING (b) WHERE doc_id % 10 = 0)
    SELECT doc_id, count(*) AS n_tokens, round(sum(l), 6) AS log_prob, round(exp(-avg(l)), 6) AS perplexity FROM e GROUP BY doc_id""")
def ngram_perplexity(spark, sf_dir):
    """A bigram model of nine documents in ten, and the perplexity of the others."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", tokens.simple_tokens(F.col("text")).alias("tokens"))
    model = ngram_model.fit(docs.where("doc_id % 10 <> 0"), "tokens", 2)
    out = ngram_model.perplexity(model, docs.where("doc_id % 10 = 0"), "tokens", "doc_id")
    return out.select("doc_id", "n_tokens", F.round("log_prob", 6).alias("log_prob"), F.round("perplexity", 6).alias("perplexity"))


@query()
def reward_model_accuracy(spark, sf_dir):
    """The pairwise model fitted on nine pairs in ten (the answer against the prompt), and its accuracy on the others; SQL can't fit it."""
    pairs = _pairs(spark, sf_dir).select("id", F.col("response").alias("chosen"), F.col("prompt").alias("rejected"), (F.crc32("id") % 10 == 0).alias("held"))
    weights = reward_model.fit(pairs.where("not held"), steps=5)
    scored = reward_model.score(reward_model.score(pairs, weights, "chosen", "c"), weights, "rejected", "r")
    return scored.groupBy("held").agg(F.count("*").alias("pairs"), F.round(stats.preference_accuracy(F.col("c"), F.col("r")), 6).alias("accuracy"))


# --- rules that had no row of their own -------------------------------------------------


@query(f"WITH {_PAIRS} SELECT id, sha256('原文：' || prompt || chr(10) || '译文：') AS translation_sha256, sha256('问题：' || prompt || chr(10) || '回答：') AS question_sha256 FROM pairs")
def plain_prompts(spark, sf_dir):
    prompts = [F.sha2(chat.plain_prompt(kind, F.col("prompt")), 256).alias(f"{kind}_sha256") for kind in ("translation", "question")]
    return _pairs(spark, sf_dir).select("id", *prompts)


@query("SELECT conv_id, arg_max(text, turn) AS completion FROM conversations GROUP BY conv_id")
def completion_texts(spark, sf_dir):
    return _chats(spark, sf_dir).select("conv_id", chat.completion_text(F.col("messages")).alias("completion"))


@query("""SELECT doc_id, ['old_to_modern', 'old_to_modern', 'modern_to_old', 'appreciation', 'creation', 'other', NULL][CAST(doc_id % 7 + 1 AS INT)] AS task FROM documents""")
def task_aliases(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("classical_to_modern", "translation", "modern_to_classical", "analysis", "writing", "other", None))), (F.col("doc_id") % 7 + 1).cast("int"))
    return _read(spark, sf_dir, "documents").select("doc_id", alias(names).alias("task"))


@query(f"WITH {_OPTIONS} SELECT bad.error AS error, count(*) AS rows FROM c WHERE bad.text <> response GROUP BY 1")
def error_types(spark, sf_dir):
    return preferences.error_counts(_preferences(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Classical' ELSE 'web' END AS category, repeat('天', CAST(doc_id % 10 AS INT)) || repeat('x', CAST(10 - doc_id % 10 AS INT)) AS t FROM documents)
    SELECT doc_id, category = 'Classical' AND doc_id % 10 / 10.0 >= 0.65 AS classical FROM d""")
def classical_gate(spark, sf_dir):
    n = (F.col("doc_id") % 10).cast("int")
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "Classical").otherwise("web").alias("category"), F.concat(F.repeat(F.lit("天"), n), F.repeat(F.lit("x"), 10 - n)).alias("t"))
    return docs.select("doc_id", teacher.is_classical(F.col("category"), F.col("t")).alias("classical"))


_WRONG = f"""{_PAIRS}, e AS (SELECT id, (length(prompt) % 70)::DOUBLE AS score, (length(response) % 50)::DOUBLE AS copied, length(response) % 20 <> 0 AS stopped, length(prompt) % 13 = 0 AS replaced, (length(response) % 9) / 60.0 AS rep, prompt, response FROM pairs),
    k AS (SELECT *, CASE WHEN score < 20 THEN 'low' WHEN score < 40 THEN 'medium' ELSE 'hard' END AS band FROM e WHERE stopped AND NOT replaced AND regexp_matches(prompt, '\\S') AND prompt <> response AND rep <= 0.10 AND score BETWEEN 3 AND 68),
    r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha256('{SEED}:band:' || id), id) AS n, CASE band WHEN 'low' THEN 12 WHEN 'medium' THEN 20 ELSE 8 END AS target FROM k),
    z AS (SELECT * FROM r WHERE n <= target UNION ALL SELECT * EXCLUDE q FROM (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:band:' || id), id) AS q FROM r WHERE n > target) WHERE q <= 40 - (SELECT count(*) FROM r WHERE n <= target))"""


@query(f"""WITH {_WRONG} SELECT (SELECT count(*) FROM e) AS candidates, (SELECT count(*) FROM k) AS eligible, count(*) AS selected, count(*) FILTER (band = 'low') AS low, count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'hard') AS hard,
    round(coalesce(avg(score), 0), 9) AS mean_rejected_chrf, round(coalesce(avg(copied), 0), 9) AS mean_source_copy_chrf FROM z""")
def repair_report(spark, sf_dir):
    """Hard negatives from model errors: what was there, what could be used, and the forty that were taken."""
    n, m = F.length("prompt"), F.length("response")
    errors = _pairs(spark, sf_dir).select("id", F.col("response").alias("chosen"), F.col("prompt").alias("rejected"), (n % 70).cast("double").alias("rejected_chrf"), (m % 50).cast("double").alias("source_copy_chrf"), (m % 20 != 0).alias("stopped"), (n % 13 == 0).alias("replacement"), ((m % 9) / 60.0).alias("repetition"))
    report = experiments.repair_pairs(errors, 40, SEED)[1]
    return report.select("candidates", "eligible", "selected", "low", "medium", "hard", F.round("mean_rejected_chrf", 9).alias("mean_rejected_chrf"), F.round("mean_source_copy_chrf", 9).alias("mean_source_copy_chrf"))


@query(f"""WITH {_BLIND}, x AS (SELECT model, response, prompt, {_REP.format("response")} AS rep FROM g WHERE model = 'alpha' OR length(response) % 2 = 0)
    SELECT model, count(*) AS rows, round(avg((length(response) % 20 <> 0)::INT), 9) AS stop_rate, round(avg(rep), 9) AS repetition, round(avg(length(prompt) % 70), 9) AS chrf FROM x GROUP BY model""")
def model_rollup(spark, sf_dir):
    rows = _generations(spark, sf_dir).where("model = 'alpha' or length(response) % 2 = 0")
    measured = rows.select("model", "response", F.col("prompt").alias("source"), (F.length("response") % 20 != 0).alias("stopped"), F.lit(False).alias("replacement"), T.repetition(F.col("response")).alias("repetition"), (F.length("prompt") % 70).alias("chrf"), F.lit(1).alias("tokens"))
    return stats.frozen_summary(measured, ["model"]).select("model", "rows", *(F.round(c, 9).alias(c) for c in ("stop_rate", "repetition", "chrf")))


_RENDERED = "array_to_string(list_transform({0}, lambda z: '<|im_start|>' || z.role || chr(10) || z.content || '<|im_end|>' || chr(10)), '')"
_CODED = "regexp_extract_all({0}, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')"


@query(f"""WITH {_CHATS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS place, 'task ' || conv_id % 3 AS task, m[-1].content AS answer FROM chats),
    t AS (SELECT task, answer, {_CODED.format(_RENDERED.format("m[1:len(m) - 1]") + " || '<|im_start|>assistant' || chr(10)")} AS p, {_CODED.format(_RENDERED.format("m"))} AS w FROM n WHERE place % 2 = 0),
    f AS (SELECT task, len(p) >= 64 AS a, len(w) > 64 AS b, w[1:len(p)] <> p AS c, length(answer) < 10 AS d, w[len(p) + 1:64] AS kept FROM t),
    g AS (SELECT *, len(list_filter(range(1, greatest(len(kept) - 5, 1)), lambda i: kept[i:i + 6] = ['<', '|', 'im', '_', 'end', '|', '>'])) > 0 AS e FROM f)
    SELECT task, grouping(task)::TINYINT AS all_tasks, count(*) AS rows, sum(a::INT)::BIGINT AS prompt_at_limit, sum(b::INT)::BIGINT AS over_limit, sum(c::INT)::BIGINT AS prefix_mismatch, sum(d::INT)::BIGINT AS short_answer, sum(e::INT)::BIGINT AS end_kept
    FROM g GROUP BY GROUPING SETS ((), (task))""")
def training_diagnosis(spark, sf_dir):
    """Counters of every second conversation by task, with a limit of 64 tokens."""
    rows = _chats(spark, sf_dir).withColumn("task", F.concat(F.lit("task "), F.col("conv_id") % 3))
    return repair.diagnosis(rows, "conv_id", limit=64, step=2)


@query(f"""WITH r AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN '请翻译：' || chr(10) || text ELSE text END AS text, ['smart_repaired', 'official_instruct', 'nobody'][CAST(conv_id % 3 + 1 AS INT)] AS model, CAST(16 + conv_id % 20 * 8 AS INT) AS n FROM conversations),
    e AS (SELECT *, list_concat(CASE WHEN model = 'nobody' THEN ['model'] ELSE [] END, list_concat(CASE WHEN role <> 'user' THEN ['last_role'] ELSE [] END, CASE WHEN n NOT BETWEEN 32 AND 512 THEN ['max_tokens'] ELSE [] END)) AS errors FROM r),
    b AS (SELECT *, CASE WHEN len(errors) > 0 THEN NULL WHEN model = 'smart_repaired' AND regexp_matches(lower(text), '翻译|译成|译为|今译|白话|现代汉语') THEN 'translation_repaired' ELSE 'official_instruct' END AS backend FROM e)
    SELECT conv_id, turn, array_to_string(errors, ',') AS errors, backend,
           CASE backend WHEN 'official_instruct' THEN sha256('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) END AS general_prompt_sha256 FROM b""")
def chat_routes(spark, sf_dir):
    """Every turn as a request of its own, checked, routed and prompted."""
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("请翻译：\n"), F.col("text"))).otherwise(F.col("text"))
    names = F.element_at(F.array(*map(F.lit, ("smart_repaired", "official_instruct", "nobody"))), (F.col("conv_id") % 3 + 1).cast("int"))
    turns = _read(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", "turn", names.alias("model"), F.array(F.struct("role", text.alias("content"))).alias("messages"), (16 + F.col("conv_id") % 20 * 8).cast("int").alias("max_tokens"))
    out = serving.routed(asked, ["official_instruct", "translation_repaired"], longest=1 << 30)
    return out.select("conv_id", "turn", F.array_join("errors", ",").alias("errors"), "backend", F.when(F.col("backend") == "official_instruct", F.sha2("prompt", 256)).alias("general_prompt_sha256"))
