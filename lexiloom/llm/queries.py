"""The registered queries of this subpackage and, where SQL can say them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, token_align, token_store, warc
from .decontaminate import contaminated
from .divergence import divergence
from .embed_dedup import link_embeddings
from .exact_dedup import equal_texts
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeats
from .suffix_dedup import repeated_spans
from .url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(~langid.held_out()), _tokenizer("piece_bpe_32k.model"))
    marked = documents.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(marked, model).select("doc_id", "held_out", "lang_pred", "score")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _tokenizer("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(_table(spark, sf_dir, "documents"), ranks, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(_table(spark, sf_dir, "pages"), warc.archive_path(spark))
    out = warc.read_archives(spark, path, with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(_table(spark, sf_dir, "embeddings"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(_table(spark, sf_dir, "documents"), token_store.store_path(spark), _tokenizer("byte_bpe_50k.json"))
    return token_store.read_index(spark, path)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_texts(_table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)})


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.summarize(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_token_store": op8_token_store,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_alignment": op13_token_alignment,
}

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op1_suffix_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w),
        k AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY array_to_string(ws[p:p + 49], ' ')) AS first FROM p),
        hit AS (SELECT doc_id, first, p, p - row_number() OVER (PARTITION BY doc_id, first ORDER BY p) AS island FROM k WHERE first < doc_id)
        SELECT doc_id, first AS first_doc_id, CAST(min(p) - 1 AS BIGINT) AS start_word, CAST(max(p) - min(p) + 50 AS BIGINT) AS n_words
        FROM hit GROUP BY doc_id, first, island""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
        FROM d""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
               AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                 WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(m, vec_id)) AS BIGINT) AS component_id,
               vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
        FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id""",
    "op10_url_filter": """
        WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
        rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        fit AS (SELECT page_id, h || p AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
                FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT s.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, 'allow') AS verdict
        FROM s LEFT JOIN fit ON fit.page_id = s.page_id AND n = 1""",
    "op9_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w),
        k AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY array_to_string(ws[p:p + 12], ' ')) AS first FROM p),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM k WHERE first < doc_id),
        each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.i) AS t
                 FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY 1)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT doc_id, text, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM g""",
    "op12_source_divergence": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        w AS (SELECT doc_id, lang, source, unnest(ws) AS term FROM d),
        vocab AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
        kept AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN vocab USING (lang, term) GROUP BY ALL),
        grp AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN vocab USING (lang) GROUP BY g.lang),
        n AS (SELECT grp.lang, grp.source, v, coalesce(sum(c), 0) AS n FROM grp JOIN v USING (lang) LEFT JOIN kept USING (lang, source) GROUP BY ALL),
        p AS (SELECT n.lang, n.source, vocab.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
              FROM n JOIN vocab USING (lang) LEFT JOIN kept ON kept.lang = n.lang AND kept.source = n.source AND kept.term = vocab.term),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS q
              FROM (SELECT lang, term, sum(c) AS c FROM kept GROUP BY ALL) JOIN (SELECT lang, any_value(v) AS v, sum(n) AS n FROM n GROUP BY lang) USING (lang)),
        pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
                 FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
                            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
                 ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        term AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
        r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
              UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
