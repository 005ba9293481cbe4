"""Audit of how the sources of a language differ in their words, in plain relational steps.

Terms are counted by language and source; each language keeps the terms that at
least ``LEAST_DOCS`` of its documents have.  Every (language, source) group is
joined with the kept vocabulary of its language, so that terms it does not have
count zero; smoothed shares are whole numbers of ``SHARE`` parts, and the
divergence of a share ``p`` from a share ``q`` is ``floor((p - q)^2 / q)``.
Groups of a language meet term by term in a self-join and are summed; terms of a
group are held against the language as a whole.

A task adds up its words before they are shuffled.  What one key can hold is
bounded by the number of groups of a language: counts by source of a term, and
the pairs of a group.  Joins with the list of groups broadcast it where it has at
most ``MOST_GROUPS`` rows, and deal the vocabulary over salts beyond that.

Defined cases: null texts, languages and sources are empty strings, and groups of
that name; a group or language without terms is there with zero counts, and its
pairs have value 0; repeated rows count again; ties rank by the item's bytes; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .storage import durable, shuffle_width

#: What a term is (all but 00-40, 5B-60 and 7B-7F; said by what it has, which Java matches many times faster), and the letters that are made small.
TERM, UPPER, LOWER = r"[A-Za-z\x80-\x{10FFFF}]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term is in; parts that a share is counted in; terms reported for a group.
LEAST_DOCS, SHARE, TOP = 3, 1_000_000_000, 200
#: Groups that are broadcast.
MOST_GROUPS = 100_000


def term_counts(df: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs`` of ``lang, source, text``: occurrences, and documents with the term."""
    words = df.select("lang", "source", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("words"))
    twice = words.select("lang", "source", F.inline(F.array(F.struct(F.lit(0).alias("once"), F.col("words").alias("ws")), F.struct(F.lit(1).alias("once"), F.array_distinct("words").alias("ws")))))
    each = twice.select("lang", "source", "once", F.explode("ws").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("count"), F.sum("once").alias("docs"))


def share(count: str, total: str, terms: str):
    """``1 + floor(SHARE * (count + 1) / (total + terms))``, exact."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(19, 0)) * cast({SHARE} as decimal(10, 0))) div cast({total} + {terms} as decimal(20, 0))")


#: Divergence of the share ``p`` from ``q``: the square fits a long, as shares are at most ``SHARE + 1``.
_VALUE = "((p - q) * (p - q)) div q"


def _meet(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row with every group of its language."""
    if groups.count() <= MOST_GROUPS:
        return rows.join(F.broadcast(groups), "lang")
    salts = shuffle_width(rows.sparkSession)
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(salts)).cast("int")).join(dealt, ["lang", "salt"]).drop("salt")


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: the ``pair`` part has the other sources of the language, the ``term`` part the terms that a source uses more than its language."""
    plain = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counted = F.map_from_entries(F.collect_list(F.struct("source", "count"))).alias("by")  # at most one for each source of the language
    terms = term_counts(plain).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all"), counted).where(F.col("docs") >= least_docs)
    vocabulary, _ = durable(terms.select("lang", "term", "all", "by", F.monotonically_increasing_id().alias("tid")), "vocabulary")

    langs = vocabulary.groupBy("lang").agg(F.sum("all").alias("n_lang"), F.count("*").alias("v"))
    sums = vocabulary.select("lang", F.explode("by").alias("source", "count")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    known = plain.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["n_lang", "v", "n"])
    groups, _ = durable(known.select("lang", "source", "n", "n_lang", "v", F.monotonically_increasing_id().alias("gid")).coalesce(1), "groups")

    # terms that a group has, against the language
    own = _meet(vocabulary.select("lang", "tid", "term", "all", "by"), groups).withColumn("count", F.element_at("by", F.col("source"))).where(F.col("count") > 0)
    valued = own.select("lang", "source", F.col("term").alias("item"), share("count", "n", "v").alias("p"), share("`all`", "n_lang", "v").alias("q")).where("p > q").withColumn("value", F.expr(_VALUE))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # groups of a language, term by term: zeros are made dense, both sides are laid out by term
    dense = _meet(vocabulary.select("lang", "tid", "by").repartition("tid"), groups).select("tid", "gid", share("coalesce(by[source], 0)", "n", "v").alias("p"))
    other = dense.select("tid", F.col("gid").alias("other"), F.col("p").alias("q"))
    summed = dense.join(other, "tid").where("gid <> other").withColumn("value", F.expr(_VALUE)).groupBy("gid", "other").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source", "gid")
    pairs = names.join(names.select("lang", F.col("source").alias("item"), F.col("gid").alias("other")), "lang").where("gid <> other").join(summed, ["gid", "other"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pairs = pairs.withColumn("value", F.coalesce("value", F.lit(0))).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return of_pairs.unionByName(of_terms)
