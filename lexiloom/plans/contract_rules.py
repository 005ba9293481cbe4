"""More registered queries: rules, gates, reviews and metrics over stub data, and oracles that take several steps of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, judging, preferences, review, sampling, sft, stats, tokens
from ..operators.acquire import pick_text
from . import corpus, experiments
from .contract import _CHATS, _GREEDY, _JUDGED, _LEN, _NORM_OF, _PAIRS, _REP, _SPLIT, _TASK, ORACLES, SEED, _chats, _docs, _pairs, _read, _shown, _stub_judgments, _tasks, query

_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

# --- oracles of queries registered elsewhere ------------------------------------

_NUMBERS = "regexp_extract_all({0}, '(?:[0-9]+(?:\\.[0-9]+)?)|[〇零一二三四五六七八九十百千万亿两壹贰叁肆伍陆柒捌玖拾佰仟]+')"
_COMMON = "coalesce(list_sum(list_transform(list_distinct(e), lambda v: least(len(list_filter(e, lambda y: y = v)), len(list_filter(a, lambda y: y = v))))), 0)"
_F1 = "2 * (({c})::DOUBLE / greatest({a}, 1)) * (({c})::DOUBLE / greatest({e}, 1)) / greatest(({c})::DOUBLE / greatest({a}, 1) + ({c})::DOUBLE / greatest({e}, 1), 1e-9)"
_CRITICAL = f"""crit AS (SELECT id, CASE WHEN len(e) = 0 AND len(a) = 0 THEN 1.0 ELSE {_F1.format(c="c", a="len(a)", e="len(e)")} END + CASE WHEN w = 0 AND g = 0 THEN 1.0 ELSE {_F1.format(c="least(w, g)", a="g", e="w")} END - 1 AS critical_token FROM
    (SELECT *, {_COMMON} AS c FROM (SELECT id, {_NUMBERS.format("prompt")} AS e, {_NUMBERS.format("response")} AS a, len(regexp_extract_all(prompt, '不|无|未|非|莫|勿|弗|毋|否')) AS w, len(regexp_extract_all(response, '并非|没有|尚未|不能|不可|不|无|未|非|莫|勿|弗|毋|否|没')) AS g FROM pairs)))"""
_GRAMS = "{0} AS (SELECT id, n, substr(t, i, n) AS gram, count(*) AS k FROM (SELECT id, n, t, unnest(range(1, length(t) - n + 2)) AS i FROM (SELECT id, regexp_replace({1}, '\\s+', '', 'g') AS t FROM pairs), (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n)) GROUP BY 1, 2, 3)"
_CHRF = f"""{_GRAMS.format("ga", "response")}, {_GRAMS.format("gb", "prompt")}, met AS (SELECT id, n, sum(least(ga.k, gb.k)) AS m FROM ga JOIN gb USING (id, n, gram) GROUP BY id, n),
    sa AS (SELECT id, n, sum(k) AS s FROM ga GROUP BY id, n), sb AS (SELECT id, n, sum(k) AS s FROM gb GROUP BY id, n),
    pq AS (SELECT id, avg(coalesce(m, 0)::DOUBLE / sa.s) AS p, avg(coalesce(m, 0)::DOUBLE / sb.s) AS q FROM sa JOIN sb USING (id, n) LEFT JOIN met USING (id, n) GROUP BY id),
    chrf AS (SELECT pairs.id, coalesce(CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) END, 0) AS chrf FROM pairs LEFT JOIN pq USING (id))"""

#: The entities of the tables, in one pass each; no other stands there.
_UNESCAPED = """regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')"""
ORACLES["normalize_pages"] = f"SELECT page_id, {_NORM_OF(_UNESCAPED)} AS text FROM pages"
ORACLES["chrf_scores"] = f"WITH {_PAIRS}, {_CHRF} SELECT id, round(chrf, 6) AS chrf FROM chrf"
ORACLES["reward_critical_token"] = f"WITH {_PAIRS}, {_CRITICAL} SELECT id, round(critical_token, 9) AS critical_token FROM crit"
ORACLES["reward_weighted"] = f"""WITH {_PAIRS}, {_CHRF}, {_CRITICAL}, x AS (SELECT *, regexp_replace(response, '\\s+', '', 'g') AS k, regexp_replace(prompt, '\\s+', '', 'g') AS p FROM pairs)
    SELECT id, round(0.35 * greatest(-1, least(1, chrf / 50 - 1)) + 0.20 * critical_token - 0.15 * greatest(0, least(1, (chrf - 70) / 30)) + 0.10 * CASE WHEN length({_STRIPPED.format("response")}) BETWEEN 8 AND 1200 THEN 1 ELSE -1 END
    + 0.10 * greatest(-1, least(1, 2 * (1.0 - {_REP.format("k")}) - 1)) + 0.10 * greatest(-1, 1 - abs(log2(greatest(length(k), 1)::DOUBLE / greatest(length(p), 1)))), 6) AS reward FROM x JOIN chrf USING (id) JOIN crit USING (id)"""
ORACLES["source_extract"] = rf"""WITH x AS (SELECT conv_id, turn, '请翻译：' || chr(10) || text AS t FROM conversations WHERE role = 'user'),
    y AS (SELECT *, regexp_extract_all(t, '[“「『"]([^”」』"]{{2,}})[”」』"]', 1) AS q, list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r\x0b\x0c]'), lambda l: {_STRIPPED.format("l")}),
        lambda l: l <> '' AND NOT regexp_matches(lower(l), '翻译|译成|译为|今译|白话|现代汉语')) AS plain FROM x)
    SELECT conv_id, turn, CASE WHEN len(q) > 0 THEN {_STRIPPED.format("list_filter(q, lambda v: length(v) = list_max(list_transform(q, lambda w: length(w))))[1]")} WHEN len(plain) > 0 THEN plain[-1]
    ELSE coalesce(nullif({_STRIPPED.format("regexp_replace(t, '^[^\n]*?[:：]', '')")}, ''), nullif({_STRIPPED.format("t")}, '')) END AS source FROM y"""
_MIX = "CAST((xor(x, x >> {0})::UHUGEINT * {1}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
ORACLES["bootstrap_ci"] = f"""WITH {_PAIRS}, d AS (SELECT id, (length(response) % 50)::DOUBLE - (length(prompt) % 50)::DOUBLE AS delta FROM pairs), v AS (SELECT delta, row_number() OVER (ORDER BY id, delta) - 1 AS place, count(*) OVER () AS n FROM d),
    c AS (SELECT count(*) AS n FROM d), r AS (SELECT n, unnest(range(0, 10000)) AS r FROM c), j AS (SELECT n, r, unnest(range(0, n)) AS j FROM r), x0 AS (SELECT n, r, ({SEED} + r * n + j)::UBIGINT AS x FROM j),
    x1 AS (SELECT n, r, {_MIX.format(30, 0xBF58476D1CE4E5B9)} AS x FROM x0), x2 AS (SELECT n, r, {_MIX.format(27, 0x94D049BB133111EB)} AS x FROM x1), x3 AS (SELECT r, CAST(xor(x, x >> 31) % n AS BIGINT) AS place FROM x2),
    m AS (SELECT r, avg(delta) AS mean FROM x3 JOIN v USING (place) GROUP BY r)
    SELECT (SELECT round(avg(delta), 9) FROM d) AS mean, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM m"""


@query(f"""WITH RECURSIVE {_GREEDY}, final AS (SELECT s.doc_id, source, CASE WHEN kind IS NOT NULL THEN [kind] ELSE reasons END AS found, {_SPLIT.format(f"sha256('{SEED}:source_id:' || source_id)")} AS split FROM s LEFT JOIN kind USING (doc_id))
    SELECT kind, name, count(*) AS rows FROM (SELECT 'split' AS kind, split AS name FROM final WHERE len(found) = 0 UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown') FROM final WHERE len(found) = 0
    UNION ALL SELECT 'rejected', unnest(found) FROM final) GROUP BY 1, 2""")
def prepare_audit_sha256(spark, sf_dir):
    # its SQL takes so many trigrams
    return corpus.audit(corpus.prepare(_docs(spark, sf_dir), "doc_id", fingerprint="sha256", max_features=dedup.MAX_FEATURES))


# --- judging -----------------------------------------------------------------------

_VALUE = "(4 * f{0} + 5 - 4 * h{0})"


@query(f"""WITH {_JUDGED} SELECT presentation_id, CASE WHEN abs({_VALUE.format("a")} - {_VALUE.format("b")}) <= 7.5 THEN 'tie' WHEN {_VALUE.format("a")} > {_VALUE.format("b")} THEN 'A' ELSE 'B' END AS better FROM v""")
def tie_margin(spark, sf_dir):
    a, b = judging.utility(F.col("judge.a")), judging.utility(F.col("judge.b"))
    return _stub_judgments(_shown(spark, sf_dir)).select("presentation_id", judging.compare(a, b, F.lit("A"), F.lit("B"), 7.5).alias("better"))


_BY_SCORE = f"CASE WHEN abs({_VALUE.format('a')} - {_VALUE.format('b')}) <= 1 THEN 'tie' WHEN ({_VALUE.format('a')} > {_VALUE.format('b')}) = a_is_chosen THEN 'chosen' ELSE 'rejected' END"


@query(f"WITH {_JUDGED}, swap AS (SELECT pair_id, min(CASE WHEN ord = 0 THEN {_BY_SCORE} END) AS x, min(CASE WHEN ord = 1 THEN {_BY_SCORE} END) AS y FROM v GROUP BY pair_id) SELECT x || '/' || y AS pattern, count(*) AS pairs FROM swap GROUP BY 1")
def score_patterns(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return judging.position_bias(_stub_judgments(shown), shown)["score_patterns"]


@query(f"WITH {_JUDGED}, swap AS (SELECT pair_id, min(CASE WHEN ord = 0 THEN w END) AS x, min(CASE WHEN ord = 1 THEN w END) AS y FROM v GROUP BY pair_id) SELECT x || '/' || y AS pattern, count(*) AS pairs FROM swap GROUP BY 1")
def pair_patterns(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return judging.position_bias(_stub_judgments(shown), shown)["pair_patterns"]


@query(f"WITH {_JUDGED} SELECT CAST(ord AS INT) AS ord, role, count(*) AS judgments FROM v GROUP BY 1, 2")
def roles_by_order(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return judging.position_bias(_stub_judgments(shown), shown)["roles_by_order"].select(F.col("order").alias("ord"), "role", F.col("rows").alias("judgments"))


@query(f"WITH {_JUDGED} SELECT count(*) AS rows, 0.0::DOUBLE AS parse_error_rate, 0.0::DOUBLE AS missing_reason_rate, count(*) FILTER (w = 'C') AS schema_violations, 0 AS spurious_c FROM v")
def bias_schema(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return judging.position_bias(_stub_judgments(shown), shown)["schema"].drop("score_agreement")


_RAW = "{0}, r AS (SELECT presentation_id, CASE WHEN fa = 0 THEN 'no answer at all' ELSE 'said: {{\"winner\": \"' || w || '\", \"a\": {{\"faithfulness\": ' || fa || '}}, \"reason\": \"{{x}}\"}} end' END AS raw, fa, w FROM v)"


@query(f"WITH {_RAW.format(_JUDGED)} SELECT presentation_id, json_extract_string(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), ''), '$.winner') AS winner, CAST(json_extract_string(nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), ''), '$.a.faithfulness') AS DOUBLE) AS faithfulness FROM r")
def judge_json(spark, sf_dir):
    rows = _stub_judgments(_shown(spark, sf_dir))
    fa = F.col("judge.a.faithfulness").cast("int")
    raw = F.when(fa == 0, "no answer at all").otherwise(F.concat(F.lit('said: {"winner": "'), F.col("judge.winner"), F.lit('", "a": {"faithfulness": '), fa.cast("string"), F.lit('}, "reason": "{x}"} end')))
    parsed = rows.select("presentation_id", judging.parse_pairwise(raw).alias("j"))
    return parsed.select("presentation_id", F.col("j.winner").alias("winner"), F.col("j.a.faithfulness").alias("faithfulness"))


@query(f"WITH {_JUDGED} SELECT presentation_id, CASE WHEN fa <> 0 AND fb <> 4 THEN fa::DOUBLE END AS faithfulness FROM v")
def score_json(spark, sf_dir):
    rows = _stub_judgments(_shown(spark, sf_dir))
    fa, fb = (F.col(f"judge.{s}.faithfulness").cast("int") for s in "ab")
    # out of range where b has four, without a field where a has none
    text = F.concat(F.lit("scores {"), F.when(fa != 0, F.lit('"faithfulness": ')).otherwise('"other": '), fa.cast("string"), F.lit(', "completeness": 1, "fluency": '), F.when(fb == 4, "3").otherwise("2"), F.lit(', "hallucination": 0} and {more}'))
    return rows.select("presentation_id", judging.parse_scores(text)["faithfulness"].alias("faithfulness"))


@query(f"""WITH {_JUDGED}, k AS (SELECT pair_id AS id, CASE WHEN r0 = 'chosen' AND r1 = 'chosen' AND cf >= rf + 1 AND ch <= rh THEN 'high_confidence' ELSE 'ambiguous_or_reversed' END AS stratum FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{SEED}:review:' || id), id) AS n FROM k)
    SELECT stratum || ':' || id AS review_id, stratum, CASE WHEN CAST(('0x' || right(sha256('{SEED}:side:' || id), 1)) AS INT) % 2 = 0 THEN 'A' ELSE 'B' END AS chosen_is FROM r WHERE n <= 50""")
def review_strata(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    merged = judging.verdicts(_stub_judgments(shown), shown)
    pairs = _pairs(spark, sf_dir).select("id", F.concat(F.lit("原文："), "prompt", F.lit("\n译文：")).alias("prompt"), F.col("response").alias("chosen"), F.col("prompt").alias("rejected"))
    known = pairs.join(merged.select(F.col("pair_id").alias("id"), "high_confidence"), "id")
    sheet, key = experiments.review_strata(known, merged, SEED)
    return sheet.join(key, "review_id").select("review_id", "stratum", "chosen_is")


# --- rules -------------------------------------------------------------------------


@query(f"""WITH {_PAIRS} SELECT id, length(response) % 9 <> 0 AND NOT contains(response, chr(65533)) AND regexp_matches(response, '\\S') AND response <> prompt AND {_REP.format("response")} <= 0.5 * 0.2 AND length(response) % 80 BETWEEN 3 AND 68 AS usable FROM pairs""")
def eligible_negatives(spark, sf_dir):
    size = F.length("response")
    return _pairs(spark, sf_dir).select("id", preferences.eligible(size % 9 != 0, F.contains("response", F.lit("�")), F.col("response"), F.col("prompt"), T.repetition(F.col("response")), size % 80).alias("usable"))


@query(f"""WITH {_PAIRS}, x AS (SELECT id, nullif(length(prompt) % 3, 0) AS n, len(list_filter(string_split_regex(response, '[\\n。！？]'), lambda l: regexp_matches(l, '\\S'))) AS lines, contains(response, 'the') AS a, contains(response, 'er') AS b FROM pairs)
    SELECT id, round(CASE WHEN n IS NULL THEN (a::INT + b::INT) / 2.0 ELSE ((lines = n)::INT + a::INT + b::INT) / 3.0 END, 9)::DOUBLE AS score FROM x""")
def constraint_accuracy(spark, sf_dir):
    wanted = F.length("prompt") % 3
    return _pairs(spark, sf_dir).select("id", F.round(review.constraint_score(F.col("response"), F.when(wanted != 0, wanted), F.array(F.lit("the"), F.lit("er"))), 9).alias("score"))


@query(f"WITH {_PAIRS}, x AS (SELECT id, replace(lower(response), ' ', '') AS p FROM pairs) SELECT id, contains(p, 'the') OR contains(p, 'undder') AS some, contains(p, 'the') AND contains(p, 'undder') AS every FROM x")
def general_knowledge(spark, sf_dir):
    terms = ["The", "und der"]
    return _pairs(spark, sf_dir).select("id", review.knows(F.col("response"), terms).alias("some"), review.knows(F.col("response"), terms, every=True).alias("every"))


@query(f"""WITH {_CHATS} SELECT conv_id, array_to_string(list_filter([CASE WHEN len(m) NOT BETWEEN 1 AND 3 THEN 'messages' END, CASE WHEN len(list_filter(m, lambda x: x.role IS NULL OR x.role NOT IN ('system', 'user', 'assistant') OR x.content IS NULL)) > 0 THEN 'roles' END,
    CASE WHEN coalesce(m[-1].role, '') <> 'user' THEN 'last_role' END, CASE WHEN 16 + conv_id % 600 NOT BETWEEN 32 AND 512 THEN 'max_tokens' END], lambda z: z IS NOT NULL), ',') AS errors FROM chats""")
def chat_payload(spark, sf_dir):
    from ..operators.chat import payload_errors

    return _chats(spark, sf_dir).select("conv_id", F.array_join(payload_errors(F.col("messages"), 16 + F.col("conv_id") % 600, 3), ",").alias("errors"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 AND regexp_matches(source, '\\S') THEN source END, CASE WHEN regexp_matches(lang, '\\S') THEN lang END) AS picked FROM documents")
def first_text_field(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise(" \n").alias("a"), F.lit(None).cast("string").alias("b"), F.col("lang").alias("c"))
    return rows.select("doc_id", pick_text(rows, ("missing", "a", "b", "c")).alias("picked"))


# Fixed values of the stub: Latin letters become ideographs, so that rules for Chinese text have some.
_LETTERS, _IDEOGRAPHS = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
_HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
_HAN_RANGE = r"[\x{3400}-\x{9fff}]"
_ITEMS = f"items AS (SELECT item_id, translate(lower(text), '{_LETTERS}', '{_IDEOGRAPHS}') AS t FROM benchmark)"


def _items(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", F.translate(F.lower("text"), _LETTERS, _IDEOGRAPHS).alias("t"))


@query(f"""WITH {_ITEMS}, d AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN text ELSE translate(text, 'aeiou', '天地玄黄宇') END AS t FROM documents)
    SELECT id, round(len(regexp_extract_all(t, '{_HAN}'))::DOUBLE / greatest({_LEN.format("t")}, 1), 9) AS blocks, round(len(regexp_extract_all(t, '{_HAN_RANGE}'))::DOUBLE / greatest(length(t), 1), 9) AS whole, round(len(regexp_extract_all(t, '{_HAN_RANGE}'))::DOUBLE / greatest({_LEN.format("t")}, 1), 9) AS visible FROM d""")
def cjk_ratios(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.translate("text", "aeiou", "天地玄黄宇")).alias("t"))
    return rows.select("id", *(F.round(T.cjk_ratio(F.col("t"), v), 9).alias(n) for n, v in (("blocks", "blocks"), ("whole", "all"), ("visible", "visible"))))


_RUN6 = "len(list_filter(range(1, length({0}) - 4), lambda i: substr({0}, i, 1) <> chr(10) AND substr({0}, i, 6) = repeat(substr({0}, i, 1), 6))) = 0"
_CLEAN = f"""{_ITEMS}, pair AS (SELECT item_id, {_STRIPPED.format("t")} AS s, {_STRIPPED.format("t || '而已' || (item_id % 7)")} AS a FROM items),
    ok AS (SELECT *, sha256(s || chr(0) || a) AS id, row_number() OVER (PARTITION BY s, a ORDER BY item_id) AS n FROM pair WHERE length(s) BETWEEN 8 AND 260 AND length(a) BETWEEN 10 AND 360 AND length(a)::DOUBLE / length(s) BETWEEN 0.55 AND 4.0
        AND len(regexp_extract_all(s, '{_HAN_RANGE}'))::DOUBLE / greatest({_LEN.format("s")}, 1) >= 0.55 AND len(regexp_extract_all(a, '{_HAN_RANGE}'))::DOUBLE / greatest({_LEN.format("a")}, 1) >= 0.55
        AND NOT regexp_matches(lower(s || a), 'http|<\\||答案：|作为ai|无法回答|translation:') AND {_RUN6.format("(s || a)")})"""


def _clean(spark, sf_dir):
    rows = _items(spark, sf_dir).select("item_id", F.lit("old_to_modern").alias("task"), F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("source_id"), F.col("t").alias("classical"), F.concat("t", F.lit("而已"), (F.col("item_id") % 7).cast("string")).alias("modern"))
    return sft.clean_translation(rows, "item_id")


@query(f"WITH {_CLEAN} SELECT id, 'item:' || item_id AS source_id, length(s) AS source_chars, length(a) AS answer_chars FROM ok WHERE n = 1")
def clean_translations(spark, sf_dir):
    return _clean(spark, sf_dir).select("id", "source_id", F.length("source_text").cast("long").alias("source_chars"), F.length("answer_text").cast("long").alias("answer_chars"))


@query(f"WITH {_CLEAN} SELECT id, '原文：' || s || chr(10) || '译文：' AS prompt, a AS reference FROM ok WHERE n = 1 ORDER BY sha256('{SEED}:train:' || id), id LIMIT 5")
def rl_prompt_rows(spark, sf_dir):
    return sft.rl_prompts(_clean(spark, sf_dir), 5, SEED, "train").select("id", "prompt", "reference")


@query(f"WITH {_PAIRS} SELECT id, {_STRIPPED.format('prompt')} AS source FROM pairs")
def source_spans(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", T.source_span(F.concat(F.lit("前言\n原文： "), F.col("prompt"), F.lit("\n译文："))).alias("source"))


# --- samples, metrics, gates -----------------------------------------------------------


@query("SELECT doc_id, ['x', 'y', 'z'][CAST((row_number() OVER (ORDER BY doc_id) - 1) % 3 + 1 AS INT)] AS task FROM documents")
def round_robin_tasks(spark, sf_dir):
    return sampling.round_robin(_read(spark, sf_dir, "documents").select("doc_id"), ["x", "y", "z"], ["doc_id"])


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id DESC LIMIT 20")
def first_examples(spark, sf_dir):
    return sampling.first_n(_read(spark, sf_dir, "documents").select("doc_id", "source", (-F.col("doc_id")).alias("last")), ["source", "last"], 20).drop("last")


@query(f"""WITH {_PAIRS}, x AS (SELECT *, {_TASK} AS task, {_REP.format("response")} AS rep FROM pairs)
    SELECT task, count(*) AS rows, round(avg((length(response) % 20 <> 0)::INT), 9) AS stop_rate, round(avg(contains(response, chr(65533))::INT), 9) AS replacement_rate, round(avg(rep), 9) AS repetition, round(avg(length(prompt) % 70), 9) AS chrf, round(avg(length(response) // 4), 9) AS tokens,
    round(avg((regexp_replace(response, '\\s+', '', 'g') = regexp_replace(prompt, '\\s+', '', 'g'))::INT), 9) AS exact_copy_rate FROM x GROUP BY task""")
def frozen_summary(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select(_tasks(F.col("id")).alias("task"), "response", F.col("prompt").alias("source"), (F.length("response") % 20 != 0).alias("stopped"), F.contains("response", F.lit("�")).alias("replacement"), T.repetition(F.col("response")).alias("repetition"), (F.length("prompt") % 70).alias("chrf"), F.floor(F.length("response") / 4).alias("tokens"))
    out = stats.frozen_summary(rows, ["task"])
    return out.select("task", "rows", *(F.round(c, 9).alias(c) for c in out.columns[2:]))


@query(f"WITH {_PAIRS} SELECT {_TASK} AS task, round(avg((length(response) % 31 > length(prompt) % 29)::INT), 9) AS accuracy FROM pairs GROUP BY 1")
def preference_accuracy(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy(_tasks(F.col("id")).alias("task")).agg(F.round(stats.preference_accuracy(F.length("response") % 31, F.length("prompt") % 29), 9).alias("accuracy"))


@query(f"""WITH {_PAIRS}, x AS (SELECT (length(response) % 11)::DOUBLE - 3 AS m, (length(prompt) % 7)::DOUBLE - 3 AS g FROM pairs), y AS (SELECT count(*) AS rows, avg((m > 0)::INT) AS accuracy, CASE WHEN count(*) <= 2 THEN 0 ELSE coalesce(corr(m, g), 0) END AS r FROM x)
    SELECT rows, round(accuracy, 9) AS accuracy, round(r, 9) AS length_correlation, accuracy >= 0.7 AND abs(r) <= 0.35 AS passed FROM y""")
def reward_calibration(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select(((F.length("response") % 11).cast("double") - 3).alias("m"), ((F.length("prompt") % 7).cast("double") - 3).alias("g"))
    out = stats.calibration(rows, "m", "g")
    return out.select("rows", F.round("accuracy", 9).alias("accuracy"), F.round("length_correlation", 9).alias("length_correlation"), "passed")


_TOKENIZED = "tk AS (SELECT id, response, regexp_extract_all(prompt, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]') AS p, list_concat(regexp_extract_all(prompt, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'), list_append(regexp_extract_all(response, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'), '<end>')) AS t FROM pairs)"


def _tokenized(spark, sf_dir):
    prompt, answer = (tokens.simple_tokens(F.col(c)) for c in ("prompt", "response"))
    return _pairs(spark, sf_dir).select("id", "response", prompt.alias("p"), F.concat(prompt, answer, F.array(F.lit("<end>"))).alias("t"))


@query(f"""WITH {_PAIRS}, {_TOKENIZED} SELECT count(*) FILTER (len(t) >= 64) AS at_limit, count(*) FILTER (len(t) > 64) AS over_limit, count(*) FILTER (t[1:len(p)] <> p) AS prefix_mismatch, count(*) FILTER (list_contains(t[1:64], '<end>')) AS end_kept, count(*) FILTER (length(response) < 10) AS short_answer FROM tk""")
def token_length_audit(spark, sf_dir):
    found = tokens.length_audit(F.col("t"), F.col("p"), F.col("response"), "<end>", 64)
    return _tokenized(spark, sf_dir).agg(*(c.alias(n) for n, c in found.items()))


@query(f"WITH {_PAIRS}, {_TOKENIZED} SELECT id, CAST(least(len(t), 64) AS INT) AS masked, CAST(greatest(least(len(t), 64) - len(p), 0) AS INT) AS learned FROM tk")
def completion_masks(spark, sf_dir):
    mask = tokens.completion_mask(F.col("p"), F.slice("t", F.size("p") + 1, F.size("t")), 64)
    return _tokenized(spark, sf_dir).select("id", F.size(mask).alias("masked"), F.aggregate(mask, F.lit(0), lambda a, b: a + b).alias("learned"))


@query("SELECT doc_id, n_chars AS even, n_chars AS third FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0")
def id_intersection(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return experiments.intersection({"even": rows.where("doc_id % 2 = 0"), "third": rows.where("doc_id % 3 = 0")}, "doc_id", "n_chars")


@query("""WITH s AS (SELECT source AS name, round(avg(n_chars % 50), 6) AS chrf, round(avg(doc_id % 3), 6) AS general FROM documents GROUP BY source) SELECT chrf, general, name FROM s WHERE general >= 0.5 ORDER BY chrf DESC, general DESC, name DESC LIMIT 1""")
def best_model(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.round(F.avg(F.col("n_chars") % 50), 6).alias("chrf"), F.round(F.avg(F.col("doc_id") % 3), 6).alias("general"))
    return stats.select_best(rows, F.col("general") >= 0.5)


@query(f"WITH {_PAIRS}, x AS (SELECT *, {_TASK} AS task, unnest(['alpha', 'beta']) AS model FROM pairs) SELECT model, count(*) AS rows, count(DISTINCT response) AS distinct_responses FROM x WHERE regexp_matches(response, '\\S') GROUP BY model")
def validity_counts(spark, sf_dir):
    rows = _pairs(spark, sf_dir).where(T.nonblank(F.col("response"))).select("id", F.lit("all").alias("task"), "response")
    n = rows.count()
    return experiments.validity_audit(rows.select("id"), rows.withColumn("model", F.explode(F.array(F.lit("alpha"), F.lit("beta")))), "id", 1, n)
