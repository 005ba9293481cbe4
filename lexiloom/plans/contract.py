"""Registered queries over the driver tables, and their SQL oracles.

The tables are adapters for the reference's record types: ``documents`` is the
corpus (category ``general_<lang>``, group key the document), ``conversations``
gives chat rows, pairs and judged presentations, ``labels`` strata, and
``benchmark`` held-out references.  Scores that a model would give are stubs
computed from hashes or lengths, in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality, rewards
from ..functions import text as T
from ..functions.hashing import keyed_hash, sha256_hex, stable_split
from ..operators import chat, dedup, judging, preferences, review, sampling, sft, stats, teacher, tokens
from ..operators.acquire import classify_instruction
from ..sources.shared import durable
from . import corpus

SEED = corpus.SEED
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out to all; larger ones as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_read(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id")).alias("source_id"), "text", F.concat(F.lit("general_"), F.col("lang")).alias("category"), "source")


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the turn before: ``id, source_id, prompt, response``."""
    c = _read(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.withColumn("prompt", before).where("role = 'assistant' and prompt is not null")
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("conv:"), F.col("conv_id")).alias("source_id"), "prompt", F.col("text").alias("response"))


# SQL pieces that several oracles share.
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NORM = r"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'),
    '[\x{200b}-\x{200f}\x{2060}\x{feff}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), chr(10)),
    lambda l: regexp_replace(regexp_replace(l, '[\t\x{00a0}\x{3000} ]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
_KEY = r"regexp_replace(lower(t), '[^\p{L}\p{N}]+', '', 'g')"
_DOCS = f"docs AS (SELECT doc_id, 'doc:' || doc_id AS source_id, {_NORM} AS t, 'general_' || lang AS category, source FROM documents)"
_FRACTION = "(CAST(('0x' || substr({0}, 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0)"
_SPLIT = f"CASE WHEN {_FRACTION} < 0.90 THEN 'train' WHEN {_FRACTION} < 0.90 + 0.05 THEN 'validation' ELSE 'test' END"
_REASONED = rf"""{_DOCS},
    l AS (SELECT *, list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r\x0b\x0c]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM docs),
    runs AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g
             FROM (SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(1, length(t) + 1)) AS i FROM docs)) WHERE c <> chr(10) GROUP BY doc_id, c, g) WHERE n >= 12),
    q AS (SELECT l.*, list_filter([CASE WHEN length(t) < 80 THEN 'too_short' END, CASE WHEN length(t) > 2000000 THEN 'too_long' END, CASE WHEN contains(t, chr(65533)) THEN 'replacement_character' END,
             CASE WHEN r.doc_id IS NOT NULL THEN 'repeated_character_run' END, CASE WHEN regexp_matches(t, '(?i)点击下载|立即注册|ICP备|cookie policy|javascript is required|广告合作') THEN 'web_boilerplate' END,
             CASE WHEN CASE WHEN len(ls) = 0 THEN 1.0 ELSE 1.0 - len(list_distinct(ls))::DOUBLE / len(ls) END > 0.45 THEN 'repeated_lines' END], lambda x: x IS NOT NULL) AS reasons
          FROM l LEFT JOIN runs r USING (doc_id)),
    s AS (SELECT *, round(greatest(0, 0.8 + least(0.2, log10(greatest(length(t), 10)) / 20) - least(1.0, 0.22 * len(reasons))), 4) AS quality_score FROM q)"""
_CHATS = "chats AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"
_PAIRS = """pairs AS (SELECT conv_id || ':' || turn AS id, 'conv:' || conv_id AS source_id, prompt, text AS response FROM
    (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations) WHERE role = 'assistant' AND prompt IS NOT NULL)"""


# --- text, quality, splits ---------------------------------------------------


@query(f"WITH {_DOCS} SELECT doc_id, t AS text FROM docs")
def normalize_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query()
def normalize_pages(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.normalize_text(F.col("html")).alias("text"))


@query(f"WITH {_DOCS} SELECT doc_id, sha256({_KEY}) AS dedup_hash, sha256(t) AS content_hash FROM docs")
def dedup_key_hash(spark, sf_dir):
    rows = corpus.normalized(_docs(spark, sf_dir))
    return rows.select("doc_id", sha256_hex(T.dedup_key(F.col("text"))).alias("dedup_hash"), sha256_hex(F.col("text")).alias("content_hash"))


@query(f"WITH {_DOCS} SELECT doc_id, row_number() OVER (PARTITION BY sha256({_KEY}) ORDER BY doc_id) > 1 AS is_duplicate FROM docs")
def exact_dedup_keep_first(spark, sf_dir):
    rows = corpus.normalized(_docs(spark, sf_dir)).select("doc_id", sha256_hex(T.dedup_key(F.col("text"))).alias("k"))
    return dedup.exact_keep_first(rows, F.col("k"), F.col("doc_id")).select("doc_id", "is_duplicate")


@query(f"WITH {_REASONED} SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted, quality_score FROM s")
def quality_reasons(spark, sf_dir):
    rows = corpus.judged(_docs(spark, sf_dir))
    return rows.select("doc_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("accepted"), "quality_score")


@query(f"WITH {_REASONED} SELECT r AS reason, count(*) AS docs FROM (SELECT unnest(reasons) AS r FROM s) GROUP BY r")
def rejection_counts(spark, sf_dir):
    return corpus.judged(_docs(spark, sf_dir)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("docs"))


@query(f"WITH {_REASONED} SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS docs, round(avg(quality_score), 6) AS mean_score FROM s WHERE len(reasons) = 0 GROUP BY 1")
def source_counts(spark, sf_dir):
    kept = corpus.judged(_docs(spark, sf_dir)).where(F.size("reasons") == 0)
    return kept.groupBy(F.coalesce(T.truthy(F.col("source")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("docs"), F.round(F.avg("quality_score"), 6).alias("mean_score"))


@query(f"SELECT doc_id, {_SPLIT.format(f'''sha256('{SEED}:source_id:doc:' || doc_id)''')} AS split FROM documents")
def stable_split_docs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", stable_split(F.concat(F.lit("source_id:"), F.col("source_id")), SEED).alias("split"))


@query(f"SELECT page_id, {_SPLIT.format(f'''sha256('{SEED}:url:' || url)''')} AS split FROM pages")
def stable_split_url(spark, sf_dir):
    from ..functions.hashing import group_key

    return _read(spark, sf_dir, "pages").select("page_id", stable_split(group_key({"url": F.col("url"), "id": F.col("page_id")}), SEED).alias("split"))


@query(f"SELECT split, count(*) AS docs FROM (SELECT {_SPLIT.format(f'''sha256('{SEED}:source_id:doc:' || doc_id)''')} AS split FROM documents) GROUP BY split")
def split_counts(spark, sf_dir):
    return stable_split_docs(spark, sf_dir).groupBy("split").agg(F.count("*").alias("docs"))


# --- near duplicates ------------------------------------------------------------

_BITS = ", ".join(f"sum((h >> {b}) & 1)::BIGINT AS b{b}" for b in range(64))
_FP = " + ".join(f"(CASE WHEN 2 * b{b} >= n THEN {1 << b}::UHUGEINT ELSE 0 END)" for b in range(64))
_PRINTS = f"""{_REASONED}, k AS (SELECT doc_id, rpad({_KEY}, greatest(length({_KEY}), 3)::INT, '_') AS v FROM s WHERE len(reasons) = 0),
    g AS (SELECT doc_id, v, length(v) - 2 AS n FROM k), i AS (SELECT doc_id, v, n, unnest(range(0, least(n, 512))) AS i FROM g),
    h AS (SELECT doc_id, CAST(('0x' || substr(sha256(substr(v, CASE WHEN n > 512 THEN (i * n) // 512 ELSE i END + 1, 3)), 1, 16)) AS UBIGINT) AS h FROM i),
    b AS (SELECT doc_id, count(*) AS n, {_BITS} FROM h GROUP BY doc_id), f AS (SELECT doc_id, ({_FP})::UBIGINT AS fp FROM b)"""
_GREEDY = f"""{_PRINTS}, e AS (SELECT b.doc_id AS n, list(a.doc_id) AS nb FROM f a JOIN f b ON a.doc_id < b.doc_id AND bit_count(xor(a.fp, b.fp)) <= 3 GROUP BY b.doc_id),
    o AS (SELECT n, nb, row_number() OVER (ORDER BY n) AS i FROM e),
    r(i, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.i, CASE WHEN len(list_filter(nb, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, n) ELSE dropped END FROM r JOIN o ON o.i = r.i + 1),
    gone AS (SELECT unnest(dropped) AS doc_id FROM (SELECT dropped FROM r ORDER BY i DESC LIMIT 1)),
    keys AS (SELECT doc_id, {_KEY} AS key FROM s WHERE len(reasons) = 0), first AS (SELECT key, min(doc_id) AS first FROM keys WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY key),
    kind AS (SELECT g.doc_id, CASE WHEN first < g.doc_id THEN 'exact_duplicate' ELSE 'near_duplicate' END AS kind FROM gone g JOIN keys USING (doc_id) LEFT JOIN first USING (key))"""


def _good_prints(spark, sf_dir, digest: str = "sha256", max_features: int | None = dedup.MAX_FEATURES) -> DataFrame:
    good = T.once(corpus.judged(_docs(spark, sf_dir), once=True).where(F.size("reasons") == 0), "k", T.dedup_key(F.col("text")))
    return good.select("doc_id", dedup.simhash(F.col("k"), digest, max_features).alias("fp"))


@query(f"WITH {_PRINTS}, c AS (SELECT fp, min(doc_id) AS doc_id FROM f GROUP BY fp) SELECT least(a.doc_id, b.doc_id) AS a, greatest(a.doc_id, b.doc_id) AS b, CAST(bit_count(xor(a.fp, b.fp)) AS INT) AS distance FROM c a JOIN c b ON a.doc_id < b.doc_id AND bit_count(xor(a.fp, b.fp)) <= 3")
def simhash_sha2_pairs(spark, sf_dir):
    return dedup.near_pairs(_good_prints(spark, sf_dir), "doc_id", "fp")


@query()
def simhash_blake2b_pairs(spark, sf_dir):
    return dedup.near_links(_good_prints(spark, sf_dir, "blake2b", None), "doc_id", "fp")


@query(f"WITH RECURSIVE {_GREEDY} SELECT doc_id, kind FROM f LEFT JOIN kind USING (doc_id)")
def near_dedup_keep_first(spark, sf_dir):
    good = T.once(corpus.judged(_docs(spark, sf_dir), once=True).where(F.size("reasons") == 0), "k", T.dedup_key(F.col("text")))
    rows, _ = durable(good.select("doc_id", sha256_hex(F.col("k")).alias("k"), dedup.simhash(F.col("k"), "sha256").alias("fp")), "fingerprints")
    return dedup.duplicate_kinds(rows, "doc_id", "k", "fp").select("doc_id", F.col("duplicate_of_kind").alias("kind"))


@query(f"""WITH RECURSIVE {_GREEDY} SELECT s.doc_id, array_to_string(CASE WHEN kind IS NOT NULL THEN [kind] ELSE reasons END, ',') AS reasons, quality_score, sha256(t) AS content_hash, category,
    {_SPLIT.format(f"sha256('{SEED}:source_id:' || source_id)")} AS split FROM s LEFT JOIN kind USING (doc_id)""")
def prepare_corpus(spark, sf_dir):
    # its SQL takes so many trigrams
    out = corpus.prepare(_docs(spark, sf_dir), "doc_id", fingerprint="sha256", max_features=dedup.MAX_FEATURES)
    return out.select("doc_id", F.array_join("reasons", ",").alias("reasons"), "quality_score", "content_hash", "category", "split")


@query()
def prepare_audit(spark, sf_dir):
    return corpus.audit(corpus.prepare(_docs(spark, sf_dir), "doc_id"))


# --- chat rows --------------------------------------------------------------------

_RENDER = "array_to_string(list_transform({0}, lambda x: '<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>' || chr(10)), '')"
_CUT = "m[1:coalesce(list_max(list_transform(range(1, len(m) + 1), lambda i: CASE WHEN m[i].role <> 'assistant' THEN i ELSE 0 END)), 0)]"


@query(f"WITH {_CHATS} SELECT conv_id, {_RENDER.format('m')} AS rendered FROM chats")
def chat_render(spark, sf_dir):
    return _chats(spark, sf_dir).select("conv_id", chat.render(F.col("messages")).alias("rendered"))


@query(f"WITH {_CHATS} SELECT conv_id, {_RENDER.format(_CUT)} || '<|im_start|>assistant' || chr(10) AS prompt FROM chats")
def prompt_without_gold(spark, sf_dir):
    return _chats(spark, sf_dir).select("conv_id", chat.prompt_text(F.col("messages")).alias("prompt"))


@query(f"WITH {_CHATS} SELECT conv_id, coalesce(list_filter(m, lambda x: x.role = 'assistant')[-1].content, '') AS reference FROM chats")
def reference_text(spark, sf_dir):
    return _chats(spark, sf_dir).select("conv_id", chat.reference_text(F.col("messages")).alias("reference"))


@query(f"WITH {_CHATS} SELECT conv_id, CAST(greatest(len(m) - 1, 0) AS INT) AS prompt_turns, m[-1].content AS completion FROM chats")
def prompt_completion_split(spark, sf_dir):
    prompt, last = chat.prompt_and_completion(F.col("messages"))
    return _chats(spark, sf_dir).select("conv_id", F.size(prompt).alias("prompt_turns"), last[0]["content"].alias("completion"))


# --- instruction data ----------------------------------------------------------------


def _tasks(id_col):
    return F.element_at(F.array(*map(F.lit, sft.TASKS)), (F.conv(F.substring(keyed_hash("task", id_col), 1, 8), 16, 10).cast("long") % 4 + 1).cast("int"))


_TASK = "['old_to_modern', 'modern_to_old', 'appreciation', 'creation'][CAST(CAST(('0x' || substr(sha256('task:' || id), 1, 8)) AS BIGINT) % 4 + 1 AS INT)]"
_NORM_OF = lambda c: _NORM.replace("nfc_normalize(text)", f"nfc_normalize({c})")
_SFT = f"""{_PAIRS}, x AS (SELECT *, {_TASK} AS task, {_NORM_OF("prompt")} AS s, {_NORM_OF("response")} AS t FROM pairs),
    v AS (SELECT *, length(t)::DOUBLE / greatest(length(s), 1) AS ratio FROM x), ok AS (SELECT * FROM v WHERE s <> '' AND t <> '' AND CASE task WHEN 'appreciation' THEN length(t) >= 6 AND ratio BETWEEN 0.02 AND 8.0
    WHEN 'modern_to_old' THEN ratio BETWEEN 0.12 AND 1.5 ELSE ratio BETWEEN 0.12 AND 8.0 END),
    u AS (SELECT *, sha256(task || chr(0) || s || chr(0) || t) AS hid, row_number() OVER (PARTITION BY task, s, t ORDER BY id) AS n FROM ok)"""


def _instructions(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("task", _tasks(F.col("id")))
    old, new = F.col("prompt"), F.col("response")
    rows = rows.withColumn("input", old).withColumn("output", new).withColumn("split", stable_split(F.col("source_id"), SEED, 0.6, 0.2))
    return rows.select("id", "source_id", "task", "input", "output", "split")


@query(f"WITH {_SFT} SELECT id, task FROM ok")
def sft_length_filter(spark, sf_dir):
    rows = _instructions(spark, sf_dir).withColumn("s", T.normalize_text(F.col("input"))).withColumn("t", T.normalize_text(F.col("output")))
    return rows.where(sft.valid_pair(F.col("s"), F.col("t"), F.col("task"))).select("id", "task")


@query(f"""WITH {_SFT} SELECT hid AS id, task, source_id, t AS answer, s AS source FROM u WHERE n = 1""")
def sft_build(spark, sf_dir):
    rows = sft.build(_instructions(spark, sf_dir), "id", SEED)
    source = F.element_at("messages", 2)["content"]
    # templates end with a line feed before the source
    return rows.select("id", "task", "source_id", chat.last_of(F.col("messages"), "assistant").alias("answer"), F.regexp_replace(source, "^[^\\n]*\\n", "").alias("source"))


@query(f"""WITH {_SFT}, sp AS (SELECT *, CASE WHEN {_FRACTION.format(f"sha256('{SEED}:' || source_id)")} < 0.6 THEN 'train' WHEN {_FRACTION.format(f"sha256('{SEED}:' || source_id)")} < 0.6 + 0.2 THEN 'validation' ELSE 'test' END AS split FROM u WHERE n = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY task, split ORDER BY sha256('{SEED}:quota:' || hid), hid) AS k FROM sp)
    SELECT task, split, hid AS id FROM r WHERE k <= CASE WHEN split = 'train' THEN 3 ELSE 1 END""")
def sft_quota(spark, sf_dir):
    return sft.build(_instructions(spark, sf_dir), "id", SEED, dict.fromkeys(sft.TASKS, 3)).select("task", "split", "id")


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(v, '翻译成古文|翻译成文言|译成文言|modern to classical') THEN 'modern_to_old' WHEN regexp_matches(v, '翻译成现代|翻译成白话|译为白话|文言文翻译|classical to modern') THEN 'old_to_modern'
    WHEN regexp_matches(v, '写诗|作诗|诗词创作|对联|仿写|续写') THEN 'creation' WHEN regexp_matches(v, '赏析|鉴赏|思想感情|表达手法') THEN 'appreciation' END AS task FROM
    (SELECT conv_id, turn, lower(CASE conv_id % 5 WHEN 0 THEN '翻译成文言：' WHEN 1 THEN '翻译成白话：' WHEN 2 THEN '写诗 ' WHEN 3 THEN '赏析 ' ELSE '' END || text) AS v FROM conversations)""")
def task_classifier(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, ("翻译成文言：", "翻译成白话：", "写诗 ", "赏析 ", ""))), (F.col("conv_id") % 5 + 1).cast("int"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", classify_instruction(F.concat(lead, F.col("text")), F.lit(None).cast("string")).alias("task"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'fixed' WHEN conv_id % 3 = 0 THEN 'translation_repaired' ELSE 'official_instruct' END AS model FROM conversations WHERE role = 'user'")
def request_router(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").where("role = 'user'")
    asked = F.concat(F.when(F.col("conv_id") % 3 == 0, "请翻译：").otherwise(""), F.col("text"))
    return rows.select("conv_id", "turn", T.route(F.when(F.col("conv_id") % 2 == 0, "fixed").otherwise("smart_repaired"), asked).alias("model"))


@query()
def source_extract(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", T.translation_source(F.concat(F.lit("请翻译：\n"), F.col("text"))).alias("source"))


# --- preferences -----------------------------------------------------------------------


def _preferences(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("task", _tasks(F.col("id"))).withColumn("messages", F.array(chat.message("user", F.col("prompt")), chat.message("assistant", F.col("response"))))
    return preferences.build(rows.select("id", "source_id", "task", "messages"), SEED)


_OPTIONS = f"""{_PAIRS}, x AS (SELECT *, {_TASK} AS task, CAST(('0x' || substr(sha256('{SEED}:' || id), 1, 8)) AS BIGINT) % 1073741824 AS pick FROM pairs WHERE regexp_matches(response, '\\S')),
    o AS (SELECT *, list_filter([CASE WHEN regexp_matches(response, '[一二三四五六七八九十百千万两0-9]') THEN {{'text': regexp_replace(response, '[一二三四五六七八九十百千万两0-9]+', CASE WHEN regexp_extract(response, '[一二三四五六七八九十百千万两0-9]+') = '三' THEN '五' ELSE '三' END), 'error': 'wrong_number'}} END,
        CASE WHEN task IN ('modern_to_old', 'creation') THEN {{'text': response || '总的来说，这个结果非常不错。', 'error': 'modern_style_intrusion'}} END,
        CASE WHEN task = 'appreciation' THEN {{'text': '作品语言优美，感情真挚，具有很高的艺术价值。', 'error': 'unsupported_appreciation'}} END], lambda z: z IS NOT NULL) AS opts FROM x),
    c AS (SELECT *, CASE WHEN len(opts) > 0 THEN opts[CAST(pick % len(opts) + 1 AS INT)] ELSE {{'text': substr(response, 1, greatest(1, CAST(floor(length(response) * 0.62) AS INT))) || '。', 'error': 'truncation'}} END AS bad FROM o)"""


@query(f"WITH {_OPTIONS} SELECT sha256(id || chr(0) || response || chr(0) || bad.text) AS id, source_id, task, bad.text AS rejected, bad.error AS error FROM c WHERE bad.text <> response")
def corrupt_negatives(spark, sf_dir):
    return _preferences(spark, sf_dir).select("id", "source_id", "task", F.col("rejected")[0]["content"].alias("rejected"), F.col("error_types")[0].alias("error"))


@query(f"""WITH {_OPTIONS} SELECT split, error, count(*) AS pairs FROM (SELECT bad.error AS error, CASE WHEN {_FRACTION.format(f"sha256('{SEED}:' || source_id)")} < 0.8 THEN 'train' WHEN {_FRACTION.format(f"sha256('{SEED}:' || source_id)")} < 0.8 + 0.1 THEN 'validation' ELSE 'test' END AS split
    FROM c WHERE bad.text <> response) GROUP BY 1, 2""")
def preference_split(spark, sf_dir):
    return _preferences(spark, sf_dir).groupBy("split", F.col("error_types")[0].alias("error")).agg(F.count("*").alias("pairs"))


def _featured(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    return rows.select("id", "source_id", F.col("response").alias("chosen"), F.col("prompt").alias("rejected"), preferences.features(F.col("prompt"), F.col("response"), F.col("prompt")).alias("features"))


_LEN = "length(regexp_replace({0}, '\\s+', '', 'g'))"
_FEATURES = f"""{_PAIRS}, f AS (SELECT id, prompt, response, {_LEN.format("response")} AS cl, {_LEN.format("prompt")} AS rl, {_LEN.format("response")}::DOUBLE / greatest({_LEN.format("prompt")}, 1) AS ratio,
    regexp_extract_all(prompt, '[0-9]+(?:\\.[0-9]+)?') AS nums, regexp_extract_all(response, '[0-9]+(?:\\.[0-9]+)?') AS got FROM pairs)"""


@query(f"WITH {_FEATURES} SELECT id, CAST(cl AS INT) AS chosen_length, CAST(rl AS INT) AS rejected_length, round(ratio, 9) AS length_ratio, len(nums) > 0 AS has_number FROM f")
def pair_features(spark, sf_dir):
    f = F.col("features")
    return _featured(spark, sf_dir).select("id", f["chosen_length"].alias("chosen_length"), f["rejected_length"].alias("rejected_length"), F.round(f["length_ratio"], 9).alias("length_ratio"), f["has_number_constraint"].alias("has_number"))


@query(f"WITH {_FEATURES} SELECT round(avg(cl), 6) AS mean, round(quantile_cont(cl, 0.5), 6) AS median, round(quantile_cont(cl, 0.05), 6) AS p05, round(quantile_cont(cl, 0.95), 6) AS p95 FROM f")
def describe_lengths(spark, sf_dir):
    out = _featured(spark, sf_dir).agg(*preferences.describe(F.col("features.chosen_length"), "n"))
    return out.select(*(F.round(f"n_{x}", 6).alias(x) for x in ("mean", "median", "p05", "p95")))


@query(f"""WITH {_FEATURES} SELECT count(*) AS pairs, round(avg((cl > rl)::INT), 6) AS chosen_longer_rate, round(avg((cl >= 1.5 * rl)::INT), 6) AS chosen_1_5x_rate, round(avg((rl >= 1.5 * cl)::INT), 6) AS rejected_1_5x_rate,
    round(avg((ratio BETWEEN 0.8 AND 1.25)::INT), 6) AS length_balanced_rate, count(*) FILTER (len(nums) > 0) AS number_cases FROM f""")
def pair_summary(spark, sf_dir):
    out = preferences.summarize(_featured(spark, sf_dir))
    return out.select("pairs", *(F.round(c, 6).alias(c) for c in ("chosen_longer_rate", "chosen_1_5x_rate", "rejected_1_5x_rate", "length_balanced_rate")), "number_cases")


_SCORED = "scored AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, (length(text) % 60)::DOUBLE AS score, CASE WHEN length(text) % 60 < 20 THEN 'low' WHEN length(text) % 60 < 40 THEN 'medium' ELSE 'hard' END AS band FROM documents)"


def _banded(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.length("text") % 60).cast("double").alias("score"))
    return rows.withColumn("band", sampling.difficulty(F.col("score")))


@query(f"WITH {_SCORED} SELECT band, count(*) AS docs FROM scored GROUP BY band")
def difficulty_bands(spark, sf_dir):
    return _banded(spark, sf_dir).groupBy("band").agg(F.count("*").alias("docs"))


_STRATA = f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha256('{SEED}:band:' || id), id) AS k, CASE band WHEN 'low' THEN 30 WHEN 'medium' THEN 50 ELSE 20 END AS target FROM scored),
    a AS (SELECT id, band FROM r WHERE k <= target), z AS (SELECT id, band FROM (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:band:' || id), id) AS q FROM r WHERE k > target) WHERE q <= 100 - (SELECT count(*) FROM a))"""


@query(f"WITH {_STRATA} SELECT id, band FROM a UNION ALL SELECT id, band FROM z")
def stratified_bands(spark, sf_dir):
    return sampling.stratified(_banded(spark, sf_dir), "band", 100, SEED, "id").select("id", "band")


@query(f"""WITH {_STRATA}, t AS (SELECT * FROM a UNION ALL SELECT * FROM z), need AS (SELECT band, count(*) AS n FROM t WHERE CAST(id AS BIGINT) % 2 = 0 GROUP BY band),
    c AS (SELECT s.id, s.band, row_number() OVER (PARTITION BY s.band ORDER BY sha256('{SEED}:match:' || s.id), s.id) AS k FROM scored s ANTI JOIN t ON s.id = t.id) SELECT id, band FROM c JOIN need USING (band) WHERE k <= n""")
def matched_controls(spark, sf_dir):
    rows = _banded(spark, sf_dir)
    chosen = sampling.stratified(rows, "band", 100, SEED, "id")
    target = chosen.where(F.col("id").cast("long") % 2 == 0)
    return sampling.match_bands(target, rows.join(chosen.select("id"), "id", "left_anti"), "band", SEED, "id").select("id", "band")


# --- tokens -------------------------------------------------------------------------------

_TOKENS = r"toks AS (SELECT doc_id, 'doc:' || doc_id AS source_id, lang, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]') AS tk FROM documents)"
_CHUNKS = f"{_TOKENS}, starts AS (SELECT *, unnest(range(0, len(tk), 256)) AS a FROM toks), chunks AS (SELECT source_id, lang, a // 256 AS chunk_index, tk[a + 1:a + 256] AS piece, source_id || '#' || (a // 256) AS chunk_id FROM starts)"


def _chunked(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("source_id"), F.col("lang").alias("category"), tokens.simple_tokens(F.col("text")).alias("tokens"))
    return tokens.chunk(rows, "tokens", "source_id", 256).withColumn("chunk_id", F.concat_ws("#", "parent_source_id", F.col("chunk_index").cast("string")))


@query(f"WITH {_CHUNKS} SELECT chunk_id, CAST(len(piece) AS INT) AS n_tokens, sha256(array_to_string(piece, ' ')) AS tokens_sha256 FROM chunks")
def token_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir).select("chunk_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"))


@query(f"""WITH {_CHUNKS}, p AS (SELECT *, len(piece) + 1 AS n, unnest([0, 1]) AS ep FROM chunks WHERE lang IN ('en', 'fr', 'de')),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY ep, sha256('{SEED}:' || ep || ':' || chunk_id), chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CASE lang WHEN 'en' THEN 10000 WHEN 'fr' THEN 6000 ELSE 4000 END AS quota FROM p)
    SELECT lang AS category, chunk_id, ep AS mixture_epoch, CAST(least(n, quota - before) AS BIGINT) AS token_count FROM r WHERE before < quota""")
def token_mixture(spark, sf_dir):
    out = tokens.token_mixture(_chunked(spark, sf_dir), {"en": 0.5, "fr": 0.3, "de": 0.2}, 20_000, SEED, "chunk_id")
    return out.select("category", "chunk_id", "mixture_epoch", "token_count")


@query(f"""WITH {_TOKENS}, e AS (SELECT doc_id, doc_id // 100 AS g, unnest(list_append(tk, '<eos>')) AS t, unnest(range(1, len(tk) + 2)) AS i FROM toks),
    p AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) - 1 AS pos FROM e)
    SELECT g AS pack_group, CAST(pos // 512 AS BIGINT) AS block_index, CAST(count(*) AS INT) AS n_tokens, sha256(string_agg(t, ' ' ORDER BY pos)) AS tokens_sha256 FROM p GROUP BY 1, 2 HAVING count(*) >= 8""")
def pack_blocks(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("g"), tokens.simple_tokens(F.col("text")).alias("tokens"))
    out = tokens.pack_blocks(rows, "tokens", "doc_id", 512, "g")
    return out.select("pack_group", "block_index", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"))


@query(f"""WITH {_CHUNKS}, w AS (SELECT lang, len(piece) - 1 AS w, (len(piece) % 7)::DOUBLE AS loss FROM chunks WHERE len(piece) >= 2)
    SELECT lang AS category, round(exp(least(sum(loss * w) / sum(w), 80)), 6) AS perplexity, CAST(sum(w) AS BIGINT) AS predicted_tokens FROM w GROUP BY lang""")
def perplexity_weighted(spark, sf_dir):
    out = tokens.perplexity(_chunked(spark, sf_dir), (F.size("tokens") % 7).cast("double"), groups=["category"])
    return out.withColumn("perplexity", F.round("perplexity", 6))


# --- evaluation sets, metrics, rewards -------------------------------------------------------


@query(f"""WITH {_PAIRS}, x AS (SELECT id, prompt, response, {_TASK} AS task FROM pairs), u AS (SELECT sha256(task || chr(0) || prompt) AS hid, task, prompt, response, row_number() OVER (PARTITION BY task, prompt ORDER BY id) AS n FROM x WHERE prompt <> '' AND response <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sha256('{SEED}:balanced:' || hid), hid) AS k FROM u WHERE n = 1) SELECT hid AS id, task, prompt, response AS reference FROM r WHERE k <= 3""")
def domain_eval_sample(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("task", _tasks(F.col("id"))).withColumn("split", F.lit("test")).withColumn("reference", F.col("response"))
    return corpus.domain_evaluation(rows.drop("response"), 3).select("id", "task", "prompt", "reference")


@query(f"""WITH x AS (SELECT doc_id, lang, {_SPLIT.format(f"sha256('{SEED}:source_id:doc:' || doc_id)")} AS split FROM documents WHERE text <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:capped:' || doc_id), doc_id) AS k FROM x WHERE split = 'test' AND lang IN ('en', 'fr')) SELECT doc_id, lang AS category FROM r WHERE k <= 20""")
def perplexity_sample(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").withColumn("category", F.col("lang")).withColumn("split", stable_split(F.concat(F.lit("source_id:doc:"), F.col("doc_id")), SEED))
    return corpus.perplexity_sets(rows.where("split = 'test'"), 20, categories=("en", "fr"), key="doc_id").select("doc_id", "category")


@query()
def chrf_scores(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(T.chrf(F.col("response"), F.col("prompt")), 6).alias("chrf"))


_REP = "CASE WHEN length({0}) >= 4 THEN 1.0 - len(list_distinct(list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4))))::DOUBLE / (length({0}) - 3) ELSE 1.0 END"


@query(f"""WITH {_PAIRS}, x AS (SELECT {_TASK} AS task, {_REP.format("response")} AS repetition, {_LEN.format("response")}::DOUBLE AS length FROM pairs)
    SELECT task, unnest(['repetition', 'length']) AS metric, round(unnest([avg(repetition), avg(length)]), 6) AS mean, count(*) AS n FROM x GROUP BY task""")
def score_summary(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("task", _tasks(F.col("id"))).withColumn("repetition", T.repetition(F.col("response"))).withColumn("length", T.compact_length(F.col("response")))
    return review.score_summary(rows, ["repetition", "length"]).withColumn("mean", F.round("mean", 6))


_F1 = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 ELSE 2.0 * {2} / greatest(1e-9, len({0}) + len({1})) END"


@query(f"""WITH {_PAIRS}, x AS (SELECT *, {_TASK} AS task, regexp_replace(response, '\\s+', '', 'g') AS k, regexp_replace(prompt, '\\s+', '', 'g') AS q, regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS st FROM pairs)
    SELECT id, CASE WHEN length(st) BETWEEN 8 AND 1200 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS nonempty, round(greatest(-1.0, least(1.0, 2 * (1.0 - {_REP.format("k")}) - 1)), 9) AS anti_repetition,
    CASE WHEN task IN ('modern_to_old', 'creation') THEN CASE WHEN regexp_matches(response, '非常|这个|所以|因为|我们|总的来说') THEN -0.5 ELSE 0.5 END WHEN task = 'appreciation' THEN CASE WHEN regexp_matches(response, '“|「|原文|句') THEN 0.5 ELSE -0.25 END ELSE 0.0 END::DOUBLE AS task_constraint,
    round(greatest(-1.0, 1 - abs(log2(greatest(length(k), 1)::DOUBLE / greatest(length(q), 1)))), 9) AS reference_length FROM x""")
def rewards_native(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("task", _tasks(F.col("id")))
    c = {"completion": F.col("response"), "task": F.col("task"), "reference": F.col("prompt"), "source": F.col("prompt")}
    r = lambda n: rewards.REGISTRY[n](**c)
    return rows.select("id", r("nonempty").alias("nonempty"), F.round(r("anti_repetition"), 9).alias("anti_repetition"), r("task_constraint").alias("task_constraint"), F.round(r("reference_length"), 9).alias("reference_length"))


@query()
def reward_critical_token(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(rewards.critical_token(completion=F.col("response"), source=F.col("prompt")), 9).alias("critical_token"))


@query()
def reward_weighted(spark, sf_dir):
    mix = rewards.MIXES["drgrpo_constraint_aware"]
    total = rewards.weighted(list(mix), list(mix.values()), completion=F.col("response"), reference=F.col("prompt"), source=F.col("prompt"))
    return _pairs(spark, sf_dir).select("id", F.round(total, 6).alias("reward"))


@query(f"WITH x AS (SELECT doc_id, {_REP.format('text')} AS r FROM documents) SELECT doc_id, round(r, 9) AS repetition FROM x")
def char_repetition(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.round(T.repetition(F.col("text")), 9).alias("repetition"))


@query(f"""WITH {_PAIRS}, x AS (SELECT id, string_split(lower(prompt), ' ') AS e, string_split(lower(response), ' ') AS a FROM pairs), u AS (SELECT id, unnest(e) AS w FROM x), v AS (SELECT id, unnest(a) AS w FROM x),
    ce AS (SELECT id, w, count(*) AS n FROM u GROUP BY 1, 2), ca AS (SELECT id, w, count(*) AS m FROM v GROUP BY 1, 2)
    SELECT id, round(sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n), 9) AS recall FROM ce LEFT JOIN ca USING (id, w) GROUP BY id""")
def multiset_recall(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(T.multiset_recall(F.split(F.lower("prompt"), " "), F.split(F.lower("response"), " ")), 9).alias("recall"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
    r AS (SELECT doc_id, ps, 1 AS i, '' AS held, NULL::VARCHAR AS done, 0 AS k FROM p UNION ALL
          SELECT doc_id, ps, i + 1, CASE WHEN i > len(ps) THEN '' WHEN held <> '' AND length(held) + length(ps[i]) > 420 THEN ps[i] ELSE held || ps[i] END,
                 CASE WHEN (i > len(ps) OR (held <> '' AND length(held) + length(ps[i]) > 420)) AND length(held) >= 48 THEN held END, i FROM r WHERE i <= len(ps) + 1)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS n, CAST(length(done) AS INT) AS chars, sha256(done) AS segment_sha256 FROM r WHERE done IS NOT NULL""")
def segment_passages(spark, sf_dir):
    # full stops of the tables stand in for the terminators
    text = F.replace(F.col("text"), F.lit("."), F.lit("。"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.segments(text)).alias("n", "s"))
    return rows.select("doc_id", "n", F.length("s").alias("chars"), F.sha2(F.replace("s", F.lit("。"), F.lit(".")), 256).alias("segment_sha256"))


@query(f"""WITH {_PAIRS}, x AS (SELECT id, response, prompt, {_TASK} AS task FROM pairs)
    SELECT id, array_to_string(list_filter([CASE WHEN length(regexp_replace(response, '^\\s+|\\s+$', '', 'g')) < 24 THEN 'answer_too_short' END, CASE WHEN length(response) > 1600 THEN 'answer_too_long' END,
    CASE WHEN task = 'appreciation' AND len(list_filter(range(1, greatest(length(prompt) - 2, 1)), lambda i: NOT contains(substr(prompt, i, 4), chr(10)) AND contains(response, substr(prompt, i, 4)))) = 0 THEN 'no_textual_overlap' END,
    CASE WHEN task = 'creation' AND len(list_filter(range(1, greatest(length(prompt) - 6, 1)), lambda i: contains(response, substr(prompt, i, 8)))) > 0 THEN 'copied_eight_char_span' END], lambda z: z IS NOT NULL), ',') AS reasons FROM x""")
def ngram_overlap_rules(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("task", _tasks(F.col("id")))
    return rows.select("id", F.array_join(teacher.rejections(F.col("task"), F.col("response"), F.col("prompt")), ",").alias("reasons"))


# --- judging --------------------------------------------------------------------------------------

_H = lambda salt: f"CAST(('0x' || substr(sha256('{salt}:' || presentation_id), 1, 8)) AS BIGINT)"
_SHOWN = f"""{_PAIRS}, o AS (SELECT *, unnest([0, 1]) AS ord, CAST(('0x' || right(sha256('{SEED}:' || id), 1)) AS INT) % 2 = 0 AS first FROM pairs),
    shown AS (SELECT 'all:' || id || ':' || ord AS presentation_id, id AS pair_id, ord, (first = (ord = 0)) AS a_is_chosen FROM o)"""
_JUDGED = f"""{_SHOWN}, j AS (SELECT *, CASE {_H("w")} % 10 WHEN 0 THEN 'TIE' WHEN 1 THEN 'C' ELSE CASE WHEN {_H("w")} % 3 = 0 THEN 'B' ELSE 'A' END END AS w,
    {_H("fa")} % 5 AS fa, {_H("fb")} % 5 AS fb, {_H("ha")} % 3 AS ha, {_H("hb")} % 3 AS hb FROM shown),
    v AS (SELECT *, CASE w WHEN 'A' THEN CASE WHEN a_is_chosen THEN 'chosen' ELSE 'rejected' END WHEN 'B' THEN CASE WHEN a_is_chosen THEN 'rejected' ELSE 'chosen' END WHEN 'TIE' THEN 'tie' ELSE 'invalid' END AS role,
        CASE WHEN a_is_chosen THEN fa ELSE fb END AS cf, CASE WHEN a_is_chosen THEN fb ELSE fa END AS rf, CASE WHEN a_is_chosen THEN ha ELSE hb END AS ch, CASE WHEN a_is_chosen THEN hb ELSE ha END AS rh FROM j),
    m AS (SELECT pair_id, min(CASE WHEN ord = 0 THEN role END) AS r0, min(CASE WHEN ord = 1 THEN role END) AS r1, min(cf) AS cf, max(rf) AS rf, max(ch) AS ch, min(rh) AS rh FROM v GROUP BY pair_id)"""


def _shown(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("id", "source_id", F.lit("all").alias("split"), F.col("response").alias("chosen"), F.col("prompt").alias("rejected"))
    return judging.presentations(rows, SEED)


def _stub_judgments(shown):
    h = lambda salt: F.conv(F.substring(keyed_hash(salt, F.col("presentation_id")), 1, 8), 16, 10).cast("long")
    winner = F.when(h("w") % 10 == 0, "TIE").when(h("w") % 10 == 1, "C").when(h("w") % 3 == 0, "B").otherwise("A")
    side = lambda s: F.struct((h("f" + s) % 5).cast("double").alias("faithfulness"), F.lit(2.0).alias("completeness"), F.lit(1.0).alias("fluency"), (h("h" + s) % 3).cast("double").alias("hallucination"))
    return shown.select("presentation_id", F.struct(winner.alias("winner"), side("a").alias("a"), side("b").alias("b"), F.lit("stub").alias("reason")).alias("judge"))


@query(f"WITH {_SHOWN} SELECT presentation_id, pair_id, CAST(ord AS INT) AS ord, CASE WHEN a_is_chosen THEN 'chosen' ELSE 'rejected' END AS option_a_role FROM shown")
def judge_presentations(spark, sf_dir):
    return _shown(spark, sf_dir).select("presentation_id", "pair_id", F.col("order").alias("ord"), "option_a_role")


@query(f"WITH {_JUDGED} SELECT pair_id, r0 || '/' || r1 AS roles, r0 = r1 AS consistent, r0 = 'chosen' AND r1 = 'chosen' AND cf >= rf + 1 AND ch <= rh AS high_confidence FROM m")
def merge_judgments(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    out = judging.verdicts(_stub_judgments(shown), shown)
    return out.select("pair_id", F.array_join("winner_roles", "/").alias("roles"), F.col("position_consistent").alias("consistent"), "high_confidence")


@query(f"""WITH {_JUDGED} SELECT count(*) AS pairs_complete, round(avg((r0 = r1)::INT), 9) AS position_consistency, round(avg((r0 = r1 AND r0 = 'chosen')::INT), 9) AS double_chosen_rate,
    count(*) FILTER (r0 = 'chosen' AND r1 = 'chosen' AND cf >= rf + 1 AND ch <= rh) AS high_confidence FROM m""")
def merge_report(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    out = judging.merge_report(judging.verdicts(_stub_judgments(shown), shown))
    return out.select("pairs_complete", F.round("position_consistency", 9).alias("position_consistency"), F.round("double_chosen_rate", 9).alias("double_chosen_rate"), "high_confidence")


@query(f"WITH {_JUDGED} SELECT CASE WHEN r0 = r1 THEN r0 || '/' || r1 ELSE 'inconsistent' END AS outcome, count(*) AS pairs FROM m GROUP BY 1")
def judge_outcomes(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return judging.outcomes(judging.verdicts(_stub_judgments(shown), shown))


@query(f"WITH {_JUDGED} SELECT CAST(ord AS INT) AS ord, w AS winner, count(*) AS judgments FROM v GROUP BY 1, 2")
def position_bias(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    out = judging.position_bias(_stub_judgments(shown), shown)["winners_by_order"]
    return out.select(F.col("order").alias("ord"), "winner", F.col("rows").alias("judgments"))


@query(f"WITH {_JUDGED} SELECT r0 || '/' || r1 AS pattern, count(*) AS pairs FROM m GROUP BY 1")
def bias_patterns(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return judging.position_bias(_stub_judgments(shown), shown)["patterns"]


@query(f"""WITH {_JUDGED} SELECT presentation_id, CAST(4 * fa + 5 - 4 * ha AS DOUBLE) AS utility_a, CAST(4 * fb + 5 - 4 * hb AS DOUBLE) AS utility_b,
    CASE WHEN abs((4 * fa - 4 * ha) - (4 * fb - 4 * hb)) <= 1 THEN 'tie' WHEN 4 * fa - 4 * ha > 4 * fb - 4 * hb THEN 'A' ELSE 'B' END AS better FROM v""")
def independent_utility(spark, sf_dir):
    a, b = judging.utility(F.col("judge.a")), judging.utility(F.col("judge.b"))
    return _stub_judgments(_shown(spark, sf_dir)).select("presentation_id", a.alias("utility_a"), b.alias("utility_b"), judging.compare(a, b, F.lit("A"), F.lit("B")).alias("better"))


# --- review, statistics, gates, joins ------------------------------------------------------------------

_BLIND = f"{_PAIRS}, g AS (SELECT *, {_TASK} AS task, unnest(['alpha', 'beta']) AS model FROM pairs), b AS (SELECT *, substr(sha256('{SEED}:' || model || ':' || id), 1, 16) AS blind_id FROM g)"


def _generations(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("task", _tasks(F.col("id"))).withColumn("reference", F.col("prompt"))
    return rows.withColumn("model", F.explode(F.array(F.lit("alpha"), F.lit("beta"))))


@query(f"WITH {_BLIND} SELECT blind_id, id AS question_id, task FROM b")
def blind_sheet(spark, sf_dir):
    return review.blind(_generations(spark, sf_dir), SEED, ["accuracy", "style"])[0].select("blind_id", "question_id", "task")


@query(f"""WITH {_BLIND}, s AS (SELECT model, task, CASE WHEN ord % 7 = 0 THEN NULL ELSE ((1 + ord % 5) + (1 + ord // 5 % 5)) / 2.0 END AS score FROM (SELECT *, CAST(('0x' || substr(blind_id, 1, 6)) AS BIGINT) AS ord FROM b))
    SELECT model, task, round(avg(score), 9) AS mean, count(score) AS reviewed, count(*) FILTER (score IS NULL) AS incomplete FROM s GROUP BY GROUPING SETS ((model), (model, task))""")
def blind_summary(spark, sf_dir):
    sheet, key = review.blind(_generations(spark, sf_dir), SEED, ["accuracy", "style"])
    n = F.conv(F.substring("blind_id", 1, 6), 16, 10).cast("long")
    filled = sheet.withColumn("scores", F.create_map(F.lit("accuracy"), F.when(n % 7 != 0, 1 + n % 5).cast("int"), F.lit("style"), (1 + F.floor(n / 5) % 5).cast("int")))
    return review.review_summary(filled, key).withColumn("mean", F.round("mean", 9))


@query(f"""WITH {_PAIRS}, d AS (SELECT id, (length(response) % 50)::DOUBLE - (length(prompt) % 50)::DOUBLE AS delta FROM pairs)
    SELECT round(avg(delta), 9) AS mean_delta, count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses FROM d""")
def paired_delta(spark, sf_dir):
    return stats.win_tie_loss(_deltas(spark, sf_dir)).withColumn("mean_delta", F.round("mean_delta", 9))


def _deltas(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    own = rows.select("id", (F.length("response") % 50).cast("double").alias("v"))
    base = rows.select("id", (F.length("prompt") % 50).cast("double").alias("v"))
    return stats.paired(own, base, "id", "v")


@query()
def bootstrap_ci(spark, sf_dir):
    out = stats.bootstrap_ci(_deltas(spark, sf_dir), "id", SEED)
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query("SELECT lang AS variant, round(avg(n_chars), 6) AS mean, round(coalesce(stddev_samp(n_chars), 0), 6) AS stdev, count(*) AS runs FROM documents GROUP BY lang")
def seed_stats(spark, sf_dir):
    out = stats.seeds(_read(spark, sf_dir, "documents").withColumnRenamed("lang", "variant"), "variant", "n_chars")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("stdev", F.round("stdev", 6))


@query("""WITH s AS (SELECT source AS name, avg((doc_id % 20 <> 0)::INT) AS stop_rate, 0.0 AS replacement_rate, 0.05 AS repetition, round(avg(n_chars % 50), 6) AS chrf, round(avg(doc_id % 3), 6) AS general FROM documents GROUP BY source)
    SELECT name, stop_rate >= 0.95 AND repetition <= 0.10 AND general >= 0.8 AS accepted FROM s""")
def acceptance_gate(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.avg((F.col("doc_id") % 20 != 0).cast("double")).alias("stop_rate"), F.lit(0.0).alias("replacement_rate"), F.lit(0.05).alias("repetition"), F.round(F.avg(F.col("n_chars") % 50), 6).alias("chrf"), F.round(F.avg(F.col("doc_id") % 3), 6).alias("general"))
    return rows.select("name", stats.capability_gate(0.9).alias("accepted"))


@query("SELECT source AS name, round(avg(n_chars), 6) AS loss, CAST(row_number() OVER (ORDER BY round(avg(n_chars), 6), source) AS INT) AS rank FROM documents GROUP BY source")
def argmin_select(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.round(F.avg("n_chars"), 6).alias("loss"))
    return sampling.argmin(rows, "loss", "name")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def pending_anti_join(spark, sf_dir):
    return judging.pending(_read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) q USING (doc_id)")
def semi_restrict(spark, sf_dir):
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _read(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


@query("SELECT doc_id, unnest(['quality', 'toxic']) AS aspect, unnest([max(quality), max(toxic)]) AS value FROM documents JOIN labels USING (doc_id) GROUP BY doc_id")
def join_unpivot(spark, sf_dir):
    last = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return _read(spark, sf_dir, "documents").select("doc_id").join(last, "doc_id").unpivot("doc_id", ["quality", "toxic"], "aspect", "value")


@query(f"""WITH {_PAIRS}, p AS (SELECT id, regexp_replace(prompt, '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS b FROM pairs)
    SELECT id || ':old_to_modern' AS id, sha256(a || chr(10) || b) AS text_sha256 FROM p WHERE a <> '' AND b <> '' UNION ALL SELECT id || ':modern_to_old', sha256(b || chr(10) || a) FROM p WHERE a <> '' AND b <> ''""")
def translation_pairs_unpivot(spark, sf_dir):
    from ..operators.acquire import Source, translation_pairs

    rows = _pairs(spark, sf_dir).select(F.col("id").alias("n"), F.col("prompt").alias("classical"), F.col("response").alias("modern"))
    out = translation_pairs(rows, Source("pairs", "json", "conversations", "classical"), "n", SEED)
    return out.select(F.substring("id", len("pairs:") + 1, 1 << 20).alias("id"), sha256_hex(F.col("text")).alias("text_sha256"))


@query(f"SELECT id FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents) ORDER BY sha256('{SEED}:probe:' || id), id LIMIT 100")
def stable_sample(spark, sf_dir):
    return sampling.sample(_read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")), 100, SEED, "probe", "id")


@query("SELECT doc_id FROM documents WHERE (SELECT count(*) FROM documents d WHERE d.doc_id < documents.doc_id) % 20 = 0")
def systematic_sample(spark, sf_dir):
    return sampling.every_nth(_read(spark, sf_dir, "documents").select("doc_id"), 20, ["doc_id"])


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from ..streaming.ingest import windowed_counts

    events = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events, "ts", "event_type", "value").select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT lang, source, count(*) AS docs, sum((length(text) < 80)::INT)::BIGINT AS short_docs, sum((quality = 1)::INT)::BIGINT AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source")
def corpus_counters(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum((F.length("text") < 80).cast("int")).alias("short_docs"), F.sum((F.col("quality") == 1).cast("int")).alias("good"))


from . import contract_data, contract_rules  # noqa: E402,F401  register more


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
