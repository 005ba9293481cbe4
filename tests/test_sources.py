import json

import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.operators import inference
from lexiloom.sources import artifacts, jsonl, registry
from lexiloom.streaming import ingest


def test_strict_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"id": "1", "n": 2}\n\n  \n{"id": "é"}\n', encoding="utf-8")
    assert [(r["id"], r["n"]) for r in jsonl.read_strict(spark, str(tmp_path / "a.jsonl"), "id string, n int").collect()] == [("1", 2), ("é", None)]
    for bad in ("[1]", '[{"id": "1"}]', "5", "{x"):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(Exception, match="not a JSON object"):
            jsonl.read_strict(spark, str(tmp_path / "b.jsonl"), "id string").collect()


def test_sink_counts_and_resumes(spark, tmp_path):
    df = spark.createDataFrame([("b", None, "字"), ("a", 1, "x")], "id string, n int, t string")
    assert jsonl.write(df, str(tmp_path / "o")) == 2
    lines = [x for p in (tmp_path / "o").glob("*.json") for x in p.read_text(encoding="utf-8").splitlines()]
    assert sorted(lines)[0] == '{"id":"a","n":1,"t":"x"}' and '"n":null' in "".join(lines) and "字" in "".join(lines)
    assert jsonl.append_pending(df, str(tmp_path / "r"), "id", lambda d: d.limit(1)) == 1
    assert jsonl.append_pending(df, str(tmp_path / "r"), "id", lambda d: d) == 1
    assert jsonl.append_pending(df, str(tmp_path / "r"), "id", lambda d: d) == 0


def test_registry_and_inspection(spark):
    with pytest.raises(ValueError, match="unknown keys"):
        registry.parse({"sources": [{"name": "a", "kind": "json", "path": "p", "category": "c", "x": 1}]})
    with pytest.raises(ValueError, match="list"):
        registry.parse({})
    rows = registry.inspect(spark.createDataFrame([("x" * 600, 1)], "t string, n int")).collect()
    assert [(r["field"], r["type"], len(r["preview"])) for r in rows] == [("t", "string", 500), ("n", "int", 1)]


def test_file_audit_reports_and_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "m.bin").write_bytes(b"abc")
    want = spark.createDataFrame([("m.bin", hashlib.sha256(b"abc").hexdigest().upper()), ("none.bin", "0")], "path string, sha256 string")
    assert {r["path"]: (r["exists"], r["matches"]) for r in artifacts.audit_files(spark, str(tmp_path), want).collect()} == {"m.bin": (True, True), "none.bin": (False, False)}
    (tmp_path / "r.json").write_text(json.dumps({"status": "complete", "metrics": {"x": 1}}))
    (tmp_path / "s.json").write_text(json.dumps({"status": "running"}))
    assert artifacts.collect_reports(spark, str(tmp_path), ["status", "metrics"]).count() == 1
    m = artifacts.Manifest({"a": 1}).to("running").to("gate_failed", why="x")
    assert json.loads(m.json())["status"] == "gate_failed"
    with pytest.raises(ValueError):
        m.to("complete")
    once = artifacts.upsert_block("# t\n", "r", "one")
    assert artifacts.upsert_block(once, "r", "two").count("r:start") == 1


def test_manifests_hash_their_inputs(spark, tmp_path):
    assert artifacts.Manifest({"a": 1, "b": 2}).input_sha256 == artifacts.Manifest({"b": 2, "a": 1}).input_sha256
    assert artifacts.Manifest({}).to("running").gate(False).status == "gate_failed"


def test_judge_runs_resume_and_gate(spark, tmp_path):
    from lexiloom.operators import judging
    from lexiloom.plans import judge_run

    pairs = spark.createDataFrame([(f"p{i}", "s", "train", f"good {{a}} {i}", "bad") for i in range(3)], "id string, source_id string, split string, chosen string, rejected string")
    shown = judging.presentations(pairs, 1)
    asked = judge_run.prompts(shown.where("pair_id = 'p0'")).first()
    assert "good {a} 0" in asked["judge_prompt"] and "bad" in asked["judge_prompt"]

    def fair():
        return lambda prompts: [('{"winner": "%s"}' % ("A" if "译文A：\ngood" in p else "B"), 1, True) for p in prompts]

    half = judge_run.pairwise(spark, shown.where("order = 0"), str(tmp_path / "half"), fair, "m")
    assert half["status"] == "gate_failed" and half["answered"] == 3

    def dying():
        import time

        answer = fair()

        def one(prompts):
            if any("good {a} 2" in p for p in prompts):
                time.sleep(3)  # the others finish meanwhile
                raise RuntimeError("lost")
            return answer(prompts)

        return one

    folder = tmp_path / "j"
    read = lambda name: json.loads((folder / name).read_text())
    with pytest.raises(Exception, match="lost"):
        judge_run.pairwise(spark, shown, str(folder), dying, "m", rows=1)
    assert read("manifest.json")["status"] == "failed" and "lost" in read("manifest.json")["error"]
    whole = judge_run.pairwise(spark, shown, str(folder), fair, "m")
    assert whole["status"] == "complete" and 0 < whole["answered"] < 6 and whole["position_consistency"] == 1.0
    assert read("manifest.json")["inputs"]["input"]["rows"] == 6 and read("report.json")["pairs"] == 3
    assert judge_run.pairwise(spark, shown, str(folder), fair, "m")["answered"] == 0
    for other, model in ((shown.withColumn("option_a", F.lit("x")), "m"), (shown, "n")):
        with pytest.raises(ValueError, match="another input"):
            judge_run.pairwise(spark, other, str(folder), fair, model)


def test_independent_judge_runs(spark, tmp_path):
    from lexiloom.operators import judging
    from lexiloom.plans import judge_run

    rows = [(f"p{i}", "s", "train", "请翻译：“学而时习之”", f"good {i}", f"bad {i}") for i in range(4)]
    pairs = spark.createDataFrame(rows, "id string, source_id string, split string, prompt string, chosen string, rejected string")
    shown = judging.presentations(pairs, 1)

    def scores():
        one = '{"faithfulness": %d, "completeness": 4, "fluency": 2, "hallucination": 0}'

        def answer(prompts):
            assert all("学而时习之" in p for p in prompts)
            said = lambda p: "no scores" if "good 3" in p else one % (4 if "good" in p or "bad 2" in p else 1)
            return [(said(p), 1, True) for p in prompts]

        return answer

    done = judge_run.independent(spark, pairs, shown, str(tmp_path / "j"), scores, "m")
    assert (done["status"], done["tasks"], done["answered"], done["unparsed"], done["pairs_complete"]) == ("complete", 16, 16, 2, 4)
    assert done["double_chosen_rate"] == 0.5 and done["position_consistency"] == 1.0
    answers = spark.read.parquet(str(tmp_path / "j" / "answers"))
    found = {r.presentation_id: r.judge for r in judge_run.independent_judgments(answers, pairs, shown).collect()}
    assert len(found) == 8
    for r in shown.collect():
        want = "INVALID" if r.pair_id == "p3" else "TIE" if r.pair_id == "p2" else "A" if r.option_a_role == "chosen" else "B"
        assert found[r.presentation_id].winner == want
    # a pair that nobody scored is invalid, not missing
    none = judge_run.independent_judgments(answers.where("pair_id <> 'p0'"), pairs, shown).where("presentation_id like '%p0%'").collect()
    assert [r.judge.winner for r in none] == ["INVALID"] * 2


def test_generation_interface(spark):
    out = inference.generate(spark.createDataFrame([("a\nlast",), (None,)], "p string"), "p", inference.echo, "stub").collect()
    assert [(r["response"], r["stopped"], r["model_path"]) for r in out] == [("last", True, "stub"), ("", True, "stub")]


def test_filters_do_not_normalise_anew(spark):
    rows = spark.createDataFrame([("a  text &amp; more", "general_en")], "text string, category string")
    plan = ingest._accepted(rows, True)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter " in x]
    assert filters and not any("regexp_replace" in x for x in filters)


def test_streaming_ingest_keeps_first(spark, tmp_path):
    text = "A sentence that is long enough to pass the length rule of the general category, surely it is."
    src, table = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, text, "general_en"), (2, text + "!", "general_en"), (3, "short", "general_en")], "id long, text string, category string")
    rows.write.parquet(src)
    for _ in range(2):
        ingest.start(spark, src, rows.schema, table, str(tmp_path / "cp")).awaitTermination()
        rows.withColumn("text", F.concat("text", F.lit("?"))).write.mode("append").parquet(src)
    assert spark.read.parquet(table).count() == 1
    assert spark.read.parquet(f"{table}-seen").count() == 1


def test_commands(spark, tmp_path):
    text = "Long enough text for the general category of the corpus, with words that differ from line to line, number "
    rows = spark.createDataFrame([(f"d{i}", f"w{i}", "general_en", text + " ".join(f"{w}{i * 37}" for w in ("ox", "elm", "fir", "yew", "ash")), "src") for i in range(6)], "id string, work string, category string, text string, source string")
    jsonl.write(rows, str(tmp_path / "raw"))
    run = lambda *a: cli.run(spark, cli.build_parser().parse_args([str(x) for x in a]))
    assert run("doctor")["time_zone"] == "UTC"
    done = run("prepare", "--input", tmp_path / "raw", "--output", tmp_path / "clean")
    assert done["kept"] >= 1
    jsonl.write(rows.withColumn("source_id", F.col("id")), str(tmp_path / "numbered"))
    with pytest.raises(ValueError, match="sum"):
        run("mix", "--input", tmp_path / "numbered", "--output", tmp_path / "mixed", "--fractions", "general_en=0.5", "--total-tokens", 50)
    mixed = run("mix", "--input", tmp_path / "numbered", "--output", tmp_path / "mixed", "--fractions", "general_en=1.0", "--total-tokens", 50)
    assert mixed["achieved"][0]["tokens"] == 50
    assert run("train", "cpt", "--input", tmp_path / "clean", "--output", tmp_path / "cpt")["rows"] >= 1
    said = run("generate", "--input", tmp_path / "raw", "--output", tmp_path / "said", "--loader", "lexiloom.operators.inference:echo", "--model", "m")
    assert said["rows"] == 6
    gen = spark.createDataFrame([("1", "t", "p", "an answer", "an answer")], "id string, task string, prompt string, response string, reference string")
    jsonl.write(gen, str(tmp_path / "gen"))
    scored = run("score", "--input", tmp_path / "gen", "--output", tmp_path / "scored")
    assert {m["metric"]: m["mean"] for m in scored["summary"]}["exact"] == 1.0
