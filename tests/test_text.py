import pytest
from pyspark.sql import functions as F

from lexiloom.functions import quality
from lexiloom.functions import text as T


def one(spark, value, build, *more):
    row = spark.createDataFrame([(value, *more)], ["t", *"abcd"[: len(more)]])
    return row.select(build.alias("x")).first()["x"]


def test_normalisation_keeps_traditional_forms_and_trims(spark):
    assert one(spark, "臺灣​　　古文 \r\n\r\n\r\n\r\n末 &amp;\n\n", T.normalize_text(F.col("t"))) == "臺灣 古文\n\n末 &"
    assert one(spark, "é", T.normalize_text(F.col("t"))) == "é"
    assert one(spark, "a\x0b\x0cb\tc", T.normalize_text(F.col("t"))) == "ab c"


def test_dedup_key_ignores_presentation(spark):
    assert one(spark, "Ab—c_ 1, D!", T.dedup_key(F.col("t"))) == "abc1d"


def test_classical_sentence_is_accepted_and_short_web_text_is_not(spark):
    rows = spark.createDataFrame([("子曰學而時習之不亦說乎有朋自遠方來不亦樂乎", "classical"), ("short", "general_en"), ("", "general_en")], ["t", "c"])
    found = [r["r"] for r in rows.select(quality.reasons(F.col("t"), F.col("c")).alias("r")).collect()]
    assert found[0] == []
    assert "too_short" in found[1]
    assert found[2] == ["too_short", "repeated_lines"]


@pytest.mark.parametrize(("value", "least", "found"), [("aaaaaaaaaaaa", 12, True), ("aaaaaaaaaaa", 12, False), ("\n" * 20, 12, False), ("\r" * 12, 12, True)])
def test_runs(spark, value, least, found):
    assert one(spark, value, T.has_run(F.col("t"), least)) is found


def test_every_quality_reason(spark):
    text = "点击下载 � " + "啊" * 12 + "\nx\nx\nx\nx" + "a" * 0
    got = one(spark, text, quality.reasons(F.col("t"), F.lit("general_zh")))
    assert set(got) >= {"too_short", "replacement_character", "repeated_character_run", "web_boilerplate", "repeated_lines"}
    assert one(spark, "x" * 3, quality.score(F.col("t"), F.array(F.lit("a")))) == 0.63
    assert one(spark, "定理 and THEOREM", quality.looks_technical(F.col("t"))) is True


def test_segments_pack_sentences(spark):
    text = "一" * 60 + "。" + "二" * 400 + "。" + "三" * 10 + "。"
    assert [len(x) for x in one(spark, text, T.segments(F.col("t")))] == [61, 412]
    assert one(spark, "短。", T.segments(F.col("t"))) == []


def test_multisets_and_ngrams(spark):
    assert one(spark, ["a", "a", "b"], T.multiset_recall(F.col("t"), F.col("a")), ["a"]) == pytest.approx(1 / 3)
    assert one(spark, "x", T.multiset_recall(F.array().cast("array<string>"), F.array(F.lit("x")))) == 1.0
    assert one(spark, "ab", T.ngrams(F.col("t"), 3)) == []
    assert one(spark, "aaaaaa", T.repetition(F.col("t"))) == pytest.approx(2 / 3)
    assert one(spark, "有3.5里，二十人", T.numbers(F.col("t"))) == ["3.5", "二十"]


def test_chrf_on_worked_cases():
    assert T._chrf("abc", "abc") == pytest.approx(100.0)
    assert T._chrf("", "abc") == 0.0
    # unigrams 1/2 and 1/2, bigrams 0: mean 1/4 each
    assert T._chrf("ab", "ac") == pytest.approx(25.0)


def test_translation_source_and_routing(spark):
    assert one(spark, "请翻译“学而时习之”和“知”", T.translation_source(F.col("t"))) == "学而时习之"
    assert one(spark, "翻译成白话\n吾日三省吾身", T.translation_source(F.col("t"))) == "吾日三省吾身"
    assert one(spark, "请翻译：温故而知新", T.translation_source(F.col("t"))) == "温故而知新"
    assert one(spark, "请译成白话", T.route(F.lit("smart_repaired"), F.col("t"))) == "translation_repaired"
    assert one(spark, "你好", T.route(F.lit("smart_repaired"), F.col("t"))) == "official_instruct"
    assert one(spark, "译为", T.route(F.lit("other"), F.col("t"))) == "other"


def test_source_span_raises_without_labels(spark):
    assert one(spark, "原文：甲乙 \n译文：", T.source_span(F.col("t"))) == "甲乙"
    with pytest.raises(Exception, match="no source span"):
        one(spark, "none", T.source_span(F.col("t")))
