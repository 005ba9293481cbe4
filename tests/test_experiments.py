import pytest
from pyspark.sql import functions as F

from lexiloom.operators import chat, judging, stats
from lexiloom.operators.sampling import QuotaError
from lexiloom.plans import experiments as E


def test_repair_pairs(spark):
    rows = [(str(i), "chosen", f"bad {i}", float(i % 80), 10.0, i % 9 != 0, False, 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, chosen string, rejected string, rejected_chrf double, source_copy_chrf double, stopped boolean, replacement boolean, repetition double")
    chosen, report = E.repair_pairs(df, 60, 1)
    r = report.first()
    assert chosen.count() == r["selected"] == 60 and (r["low"], r["medium"], r["hard"]) == (18, 30, 12) and r["candidates"] == 400
    assert r["eligible"] == sum(1 for x in rows if x[5] and 3 <= x[3] <= 68)


def test_ablation_sets_and_strata(spark):
    rows = [(f"p{i}", "s", "train" if i < 40 else "validation", f"原文：甲{i}\n译文：", f"chosen text {i}", f"rejected text {i}", float(i % 60)) for i in range(60)]
    pairs = spark.createDataFrame(rows, "id string, source_id string, split string, prompt string, chosen string, rejected string, rejected_chrf double")
    shown = judging.presentations(pairs.withColumn("features", F.struct(F.lit(1.0).alias("length_ratio"))), 1)
    good, bad = (4.0, 4.0, 2.0, 0.0), (1.0, 2.0, 2.0, 1.0)
    said = [(r["presentation_id"], ("A" if a else "B", good if a else bad, bad if a else good, "x") if int(r["pair_id"][1:]) % 2 else ("TIE", good, good, "x")) for r in shown.collect() for a in [r["option_a_role"] == "chosen"]]
    judgments = spark.createDataFrame(said, f"presentation_id string, judge {judging.JUDGE}")
    limits = {"train": (5, 3), "validation": (2, 1)}
    out = E.ablation_sets(pairs, shown, judgments, 1, limits)
    high, controls = out["high_confidence:train"].collect(), out["length_matched:train"].collect()
    assert len(high) == 5 and all(int(r["id"][1:]) % 2 for r in high)
    assert sorted(r["band"] for r in high) == sorted(r["band"] for r in controls) and not {r["id"] for r in high} & {r["id"] for r in controls}
    assert out["grpo:train"].first()["source_text"].startswith("甲")
    sheet, key = out["review_sheet"].collect(), {r["review_id"]: r for r in out["review_key"].collect()}
    # seven confident pairs were selected, and thirty were not confident
    assert len(sheet) == 37 and {s["stratum"] for s in sheet} == {"high_confidence", "ambiguous_or_reversed"} and all(s["human_fidelity_a"] is None and s["human_fidelity_b"] is None for s in sheet)
    assert all(k["judge"]["pair_id"] == k["pair_id"] and k["judge"]["high_confidence"] == r.startswith("high") for r, k in key.items())
    assert all((s["option_a"] if key[s["review_id"]]["chosen_is"] == "A" else s["option_b"]).startswith("chosen") for s in sheet)
    with pytest.raises(stats.GateError):
        E.ablation_sets(pairs, shown, judgments, 1, {"train": (50, 45)})


def test_pilot_never_crosses_splits(spark):
    def row(i, split, source_id, answer):
        return (f"r{i}", "old_to_modern", split, E.PILOT_PROVENANCE, source_id, [("user", "问题内容"), ("assistant", answer)], 10)

    rows = [row(0, "test", "g1", "这是足够长的答案内容甲乙"), row(1, "train", "g1", "这是另外一个足够长的答案内"), row(2, "train", "g2", "这是足够长的答案内容甲乙"), row(3, "train", "g3", "第三个足够长的答案内容在此"), row(4, "train", "g4", "答案：这是足够长的答案内容")]
    df = spark.createDataFrame(rows, f"id string, task string, split string, provenance string, source_id string, messages {chat.MESSAGES}, n int")
    assert {r["id"] for r in E.pilot(df, 1, "n", {"test": 1, "train": 1}).collect()} == {"r0", "r3"}
    with pytest.raises(QuotaError):
        E.pilot(df, 1, "n", {"test": 1, "train": 2})


def test_audits(spark):
    q = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4)], "id long, task string")
    o = q.crossJoin(spark.createDataFrame([("m1",), ("m2",)], "model string")).withColumn("response", F.concat("model", F.col("id").cast("string")))
    assert {r["model"]: (r["rows"], r["distinct_responses"]) for r in E.validity_audit(q, o, "id", 2, 2).collect()} == {"m1": (4, 4), "m2": (4, 4)}
    with pytest.raises(stats.GateError):
        E.validity_audit(q, o.where("id <> 0 or model <> 'm1'"), "id", 2, 2)
    assert E.intersection({"a": o.where("model='m1'"), "b": o.where("model='m2' and id > 0")}, "id", "response", 3).count() == 3
    with pytest.raises(stats.GateError):
        E.intersection({"a": o.where("model='m1'")}, "id", "response", 5)
    assert E.latest_checkpoint(["checkpoint-9", "x/checkpoint-100", "checkpoint-best"]) == "x/checkpoint-100"
    assert E.is_complete('{"status": "complete"}', True) and not E.is_complete(None, True)
