"""Look-up joins, the n-gram model, the reward model and the state of the stream."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.functions import text as T
from lexiloom.operators import joins, ngram_model, reward_model, stats, tokens
from lexiloom.operators.stats import GateError
from lexiloom.plans import experiments, repair, runner, serving
from lexiloom.sources import jsonl
from lexiloom.streaming import ingest


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lookup_of_hot_null_and_missing_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(None, -1), ("lost", -2)] + [(f"k{i % 40}", i) for i in range(80)], "k string, is_hot int")
    table = spark.createDataFrame([("hot", 1, "x"), ("unused", 2, "y")] + [(f"k{i}", i, None) for i in range(40)], "k string, found int, z string")
    want = rows_of(rows.join(table, "k", "left").select("k", "is_hot", "found", "z"))
    assert rows_of(joins.lookup(rows, table, "k").select("k", "is_hot", "found", "z")) == want
    counts = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    assert rows_of(joins.lookup(rows, table, "k", counts).select("k", "is_hot", "found", "z")) == want
    assert joins.lookup(rows.limit(0), table, "k").count() == 0 and joins.lookup(rows, table.limit(0), "k").where("found is not null").count() == 0


# --- n-gram model -----------------------------------------------------------------


def kneser_ney(docs, order, d):
    """p(word, context) from the definition."""
    counts = [Counter() for _ in range(order)]
    for doc in docs:
        padded = [ngram_model.BEGIN] * (order - 1) + doc + [ngram_model.END]
        counts[-1].update(tuple(padded[i : i + order]) for i in range(len(padded) - order + 1))
    for k in range(order - 2, -1, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    total, types = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for k in range(order):
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            types[k][g[:-1]] += 1
    size = len(counts[0]) + 1

    def p(word, context):
        k = len(context)
        below = p(word, context[1:]) if k else 1 / size
        if context not in total[k]:
            return below
        return max(counts[k][(*context, word)] - d, 0) / total[k][context] + d * types[k][context] / total[k][context] * below

    return p, {g[0] for g in counts[0]}


@pytest.mark.parametrize(("order", "discount"), [(1, 0.75), (2, 0.5), (3, 0.75), (4, 0.9)])
def test_model_follows_its_definition(spark, order, discount):
    r = random.Random(order)
    docs = [r.choices("abcde", weights=[9, 4, 2, 1, 1], k=r.randint(0, 12)) for _ in range(25)]
    p, known = kneser_ney(docs, order, discount)
    model = ngram_model.fit(spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(99, None)], "id int, t array<string>").repartition(3), "t", order, discount)
    assert model.vocabulary == len(known) + 1
    contexts = {tuple(([ngram_model.BEGIN] * (order - 1) + doc)[i : i + order - 1]) for doc in docs for i in range(len(doc) + 1)} | {("a", "never", "e")[3 - order + 1 :] if order > 1 else ()}
    contexts = {c for c in contexts if len(c) == order - 1}
    words = [*known, "never"]
    asked = spark.createDataFrame([([*c, w],) for c in contexts for w in words], "gram array<string>")
    got = {tuple(x.gram): x.p for x in ngram_model.probabilities(model, asked).collect()}
    assert len(got) == len(contexts) * len(words)
    for c in contexts:
        assert sum(got[(*c, w)] for w in words) == pytest.approx(1)
        for w in words:
            assert got[(*c, w)] == pytest.approx(p(w, c))


def test_perplexity_of_documents(spark):
    train, held = [["a", "b"], ["a", "b", "b"], []], [(1, ["a", "b", "z"]), (2, []), (3, None), (4, ["a"] * 50)]
    p, _ = kneser_ney(train, 2, 0.75)
    model = ngram_model.fit(spark.createDataFrame([(t,) for t in train], "t array<string>"), "t", 2)
    got = {r.id: r for r in ngram_model.perplexity(model, spark.createDataFrame([(i, t, 7) for i, t in held], "id int, t array<string>, padded int"), "t", "id").collect()}
    assert set(got) == {1, 2, 4}
    for i, t in held:
        if t is not None:
            row = [ngram_model.BEGIN, *t, ngram_model.END]
            logs = [math.log(p(w, (h,))) for h, w in zip(row, row[1:], strict=False)]
            assert (got[i].n_tokens, got[i].log_prob) == (len(logs), pytest.approx(sum(logs)))
            assert got[i].perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)))


def test_runs_cut_texts_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, text string").select("id", tokens.simple_tokens("text").alias("tokens"))
    cut = ngram_model.runs(df, "tokens", 2, "id")
    assert {(r.id, *r.gram) for r in cut.collect()} == {(1, ngram_model.BEGIN, "a"), (1, "a", "b"), (1, "b", ngram_model.END), (3, ngram_model.BEGIN, ngram_model.END)}
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_model_without_training(spark):
    model = ngram_model.fit(spark.createDataFrame([], "t array<string>"), "t", 3)
    got = ngram_model.perplexity(model, spark.createDataFrame([(1, ["a", "b"])], "id int, t array<string>"), "t", "id").first()
    assert (got.n_tokens, got.perplexity) == (3, pytest.approx(1))
    with pytest.raises(ValueError, match="discount"):
        ngram_model.fit(spark.createDataFrame([], "t array<string>"), "t", 3, 1.0)


def test_perplexity_command_fits_a_model(spark, tmp_path):
    rows = spark.createDataFrame([("the cat sat on the mat",), ("the dog sat on the log",)] * 5, "text string")
    jsonl.write(rows, str(tmp_path / "train"))
    for name, text in (("near", "the cat sat on the log"), ("far", "zebra quantum flux")):
        jsonl.write(spark.createDataFrame([(text,)], "text string"), str(tmp_path / name))
    run = lambda *a: cli.run(spark, cli.build_parser().parse_args([str(x) for x in a]))
    near, far = (run("perplexity", "--input", tmp_path / n, "--train", tmp_path / "train", "--order", 2)["perplexity"][0] for n in ("near", "far"))
    assert near["predicted_tokens"] == 7 and far["predicted_tokens"] == 4 and near["perplexity"] < 5 < far["perplexity"]


def test_equal_documents_weigh_alike(spark):
    once, docs = defaultdict(float), [["a", "b", "c"], ["a", "c"]]
    for times in (1, 3):
        model = ngram_model.fit(spark.createDataFrame([(t,) for t in docs * times], "t array<string>"), "t", 1)
        once[times] = {tuple(r.gram): r.p for r in model.grams[0].collect()}
    assert once[3][("c",)] > once[1][("c",)]  # counts grow, the discount does not


# --- the state of the stream ---------------------------------------------------------


def test_a_batch_reads_its_own_state(spark, tmp_path):
    text = "A sentence that is long enough to pass the length rule of the general category, surely it is, and number "
    words = [f"{a} {b} {c}" for a in ("ox", "elm", "fir", "yew") for b in ("oak", "ash", "bay", "fig") for c in "pqrstuvwxyz"]
    schema = "id long, text string, category string"
    make = lambda ws: spark.createDataFrame([(i, text + w, "general_en") for i, w in enumerate(ws)], schema)
    src, table, point = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        gets, kept = [], []
        for ws in (words[:120], words[118:123], words[:3] + words[130:131]):
            make(ws).coalesce(1).write.mode("append").parquet(src)
            query = ingest.start(spark, src, schema, table, point)  # each time a restart
            query.awaitTermination()
            operator = next(p["stateOperators"][0] for p in reversed(query.recentProgress) if p["numInputRows"])
            gets.append(int(operator["customMetrics"]["rocksdbGetCount"]))
            kept.append(spark.read.parquet(table).count())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert kept == [120, 123, 124]
    assert gets[0] >= 120 and gets[1] <= 2 * 5 and gets[2] <= 2 * 4  # a batch asks for its own keys
    assert spark.read.parquet(f"{table}-seen").select("content_hash").distinct().count() == 124


def test_tokens_of_one_sign_are_no_marks():
    assert len(ngram_model.BEGIN) > 1 and len(ngram_model.END) > 1 and tokens.MAX_TOKENS > 0


# --- chrF --------------------------------------------------------------------------------


def chrf_by_definition(hypothesis, reference, order=6, beta=2.0):
    h, r = "".join(hypothesis.split()), "".join(reference.split())
    ps, rs = [], []
    for n in range(1, order + 1):
        a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (h, r))
        if a and b:
            both = sum((a & b).values())
            ps.append(both / sum(a.values()))
            rs.append(both / sum(b.values()))
    p, q = (sum(x) / len(x) if x else 0.0 for x in (ps, rs))
    return 100 * (1 + beta**2) * p * q / (beta**2 * p + q) if p + q else 0.0


SHORT = st.text(alphabet=st.sampled_from("ab 学\U0001f600\n"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(SHORT, SHORT), max_size=6))
def test_chrf_of_a_batch(pairs):
    got = T.chrf_rows([a for a, _ in pairs], [b for _, b in pairs])
    assert got == pytest.approx([chrf_by_definition(a, b) for a, b in pairs])


def test_chrf_column_takes_nulls_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(T, "CHRF_GROUP", 100)
    r = random.Random(1)
    pairs = [(None, "a"), ("a", None), (None, None), ("", "")] + [("".join(r.choices("abc ", k=k)), "".join(r.choices("abc ", k=k))) for k in (1, 30, 99, 101, 5000)]
    got = spark.createDataFrame(pairs, "h string, r string").coalesce(1).select(T.chrf(F.col("h"), F.col("r")).alias("c")).collect()
    assert [x.c for x in got] == pytest.approx([chrf_by_definition(h or "", r or "") for h, r in pairs])
    assert spark.createDataFrame([], "h string, r string").select(T.chrf(F.col("h"), F.col("r"))).count() == 0


# --- the reward model ------------------------------------------------------------------


def reward_pairs(n=120, seed=4):
    r = random.Random(seed)
    good, bad, same = ["clear", "exact", "brief"], ["vague", "wrong", "long"], ["the", "text", "is", "so"]
    make = lambda own: " ".join(r.choices(same, k=5) + r.choices(own, k=2))
    return [(make(good), make(bad)) if r.random() < 0.95 else (make(bad), make(good)) for _ in range(n)] + [("equal", "equal"), (None, "wrong"), ("exact", "")]


def dense(spark, rows, width):
    hashed = spark.createDataFrame(rows, "chosen string, rejected string").select(reward_model.features(F.col("chosen"), width).alias("a"), reward_model.features(F.col("rejected"), width).alias("b")).collect()
    count = lambda x: np.bincount(np.array(x, dtype=int), minlength=width)
    return np.array([count(x.a) - count(x.b) for x in hashed], dtype=float)


def test_fitted_weights_are_the_optimum(spark):
    rows, width, l2 = reward_pairs(), 64, 0.05
    x = dense(spark, rows, width)
    measure = lambda w: (np.logaddexp(0, -x @ w).mean() + l2 / 2 * w @ w, -(x / (1 + np.exp(x @ w))[:, None]).mean(axis=0) + l2 * w)
    want = np.zeros(width)
    for _ in range(100):  # Newton's method, on a matrix that fits
        p = 1 / (1 + np.exp(x @ want))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(width), measure(want)[1])
        want = want - step
    got = {parts: reward_model.fit(spark.createDataFrame(rows, "chosen string, rejected string").repartition(parts), width=width, l2=l2) for parts in (1, 5)}
    assert np.abs(measure(want)[1]).max() < 1e-10
    for w in got.values():
        assert np.allclose(w, want, atol=1e-4) and measure(w)[0] == pytest.approx(measure(want)[0], abs=1e-8)


def test_scores_rank_held_out_pairs(spark):
    weights = reward_model.fit(spark.createDataFrame(reward_pairs(), "chosen string, rejected string"), width=1 << 13)
    held = spark.createDataFrame(reward_pairs(80, 9), "chosen string, rejected string")
    scored = reward_model.score(reward_model.score(held, weights, "chosen", "c"), weights, "rejected", "r")
    assert scored.agg(F.avg((F.col("c") > F.col("r")).cast("double"))).first()[0] > 0.85
    assert scored.where("chosen is null").first()["c"] == 0.0
    assert not reward_model.fit(held.limit(0), width=32).any()


def test_gradient_pieces_make_the_gradient(spark, monkeypatch):
    monkeypatch.setattr(reward_model, "PIECE", 7)
    rows, width = reward_pairs(30), 50
    x, w = dense(spark, rows, width), np.linspace(-1, 1, width)
    pairs = spark.createDataFrame(rows, "chosen string, rejected string").select(reward_model.features(F.col("chosen"), width).alias("chosen"), reward_model.features(F.col("rejected"), width).alias("rejected")).repartition(6)
    loss, slope = reward_model.loss_and_gradient(pairs, w, 0.1, len(rows))
    assert loss == pytest.approx(np.logaddexp(0, -x @ w).mean() + 0.05 * w @ w)
    assert np.allclose(slope, -(x / (1 + np.exp(x @ w))[:, None]).mean(axis=0) + 0.1 * w)


# --- stages and plans -------------------------------------------------------------------


def test_stages_are_done_once(spark, tmp_path):
    ran = []

    def plus(x, s):
        ran.append(("plus", s["by"]))
        return x["rows"].select((F.col("n") + s["by"]).alias("n"))

    def total(x, s):
        ran.append("total")
        return x["plus"].agg(F.sum("n").alias("n"))

    rows = spark.range(10).toDF("n")
    make = lambda by, gate=None: [runner.Stage("plus", ("rows",), plus, {"by": by}), runner.Stage("total", ("plus",), total, {}, gate)]
    go = lambda *a, df=rows: runner.run(spark, str(tmp_path), {"rows": df}, make(*a))
    first = go(1)
    assert first["total"].frame.first().n == 55 and ran == [("plus", 1), "total"] and first["total"].fresh
    assert not go(1)["total"].fresh and len(ran) == 2
    assert go(2)["total"].frame.first().n == 65 and ran[2:] == [("plus", 2), "total"]
    # another input, but the same table comes out: the stage behind is not run again
    assert go(1, df=spark.range(1, 11).toDF("n").select(F.col("n") - 1).toDF("n"))["total"].fresh is False and len(ran) == 4
    assert go(0, df=spark.range(1, 11).toDF("n"))["plus"].fresh and ran[4:] == [("plus", 0)]
    with pytest.raises(ValueError, match="later"):
        runner.run(spark, str(tmp_path), {"rows": rows}, make(1)[::-1])
    with pytest.raises(ValueError, match="repeat"):
        runner.run(spark, str(tmp_path), {"plus": rows}, make(1))


def test_gates_and_failed_stages(spark, tmp_path):
    rows, state = spark.range(3).toDF("n"), {"broken": True, "ran": 0}

    def work(x, s):
        state["ran"] += 1
        if state["broken"]:
            raise RuntimeError("lost")
        return x["rows"]

    stages = [runner.Stage("work", ("rows",), work, {}, lambda df: (df.count() > 3, {"rows": df.count()}), version="1")]
    with pytest.raises(RuntimeError, match="lost"):
        runner.run(spark, str(tmp_path), {"rows": rows}, stages)
    state["broken"] = False
    for _ in range(2):  # the verdict is kept, the work not done again
        with pytest.raises(GateError, match="'rows': 3"):
            runner.run(spark, str(tmp_path), {"rows": rows}, stages)
    assert state["ran"] == 2
    assert runner.run(spark, str(tmp_path), {"rows": spark.range(5).toDF("n")}, stages)["work"].facts == {"rows": 5}


def translations(spark):
    hanzi = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜"
    rows = []
    for i in range(36):
        source = hanzi[i % 20 : i % 20 + 10] + hanzi[i]
        rows.append((i, f"s{i}", ["train", "validation", "test"][i % 3], "old_to_modern", source, "今译" + source[::-1] + "也"))
    return spark.createDataFrame(rows, "n int, source_id string, split string, task string, classical string, modern string")


def model(answers, calls):
    def load():
        def answer(prompts):
            return [(answers(p), 5, True) for p in prompts]

        return answer

    return load


def test_capability_repair_end_to_end(spark, tmp_path):
    rows = translations(spark)
    good = lambda p: "Paris it is" if "France" in p else "今译" + p.split("原文：")[-1].split("\n")[0][::-1] + "也"
    candidates = [
        repair.Candidate("base", model(lambda p: "Paris" if "France" in p else "无", None), "chat", "w1"),
        repair.Candidate("tuned", model(good, None), "plain", "w1"),
        repair.Candidate("broken", model(lambda p: "�", None), "plain", "w1"),
    ]
    questions = [repair.Question("Capital of France?", ("paris",)), repair.Question("Name both.", ("a", "b"), True)]
    limits = {"train": 5, "validation": 2, "test": 4}
    go = lambda cs=candidates, lim=limits: repair.capability_repair(spark, str(tmp_path), rows, "n", cs, questions, "base", 1, lim)
    done = go()
    assert {s: r["count"] for s, r in ((r["split"], r) for r in done["repair_rows"].frame.groupBy("split").count().collect())} == limits
    assert done["selection"].frame.first()["name"] == "tuned" and done["selection"].facts["selected"] == "tuned"
    found = {r["name"]: r for r in done["summaries"].frame.collect()}
    assert found["tuned"]["chrf"] == pytest.approx(100) and found["broken"]["replacement_rate"] == 1.0 and found["base"]["general"] == 0.5
    assert not any(r.fresh for r in go().values())
    retrained = [*candidates[:2], repair.Candidate("broken", model(good, None), "plain", "w2")]
    again = {n for n, r in go(retrained).items() if r.fresh}
    assert again == {"translations-broken", "general-broken", "summary-broken", "summaries", "selection"}
    assert "repair_rows" in {n for n, r in go(candidates, limits | {"train": 6}).items() if r.fresh}
    repaired = done["repair_rows"].frame
    with pytest.raises(ValueError, match="already"):
        repair.evaluate_checkpoint(spark, str(tmp_path), repaired, candidates[0], questions, done["summaries"].frame)
    late = repair.evaluate_checkpoint(spark, str(tmp_path), repaired, repair.Candidate("late", model(good, None), "plain", "w1"), questions, done["summaries"].frame)
    assert late.first()["chrf"] == pytest.approx(100)
    with pytest.raises(GateError):
        repair.capability_repair(spark, str(tmp_path / "none"), rows, "n", [candidates[2]], questions, "broken", 1, limits)
    with pytest.raises(Exception, match="too few"):
        repair.capability_repair(spark, str(tmp_path / "short"), rows, "n", candidates, questions, "base", 1, {"test": 99})


def test_training_data_diagnosis(spark, tmp_path):
    chat = lambda asked, said: [("user", asked), ("assistant", said)]
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"src{i}", chat("ask " * (i + 1), "short" if i % 4 == 0 else "a longer answer " * (i + 1))) for i in range(24)], "n int, task string, provenance string, messages array<struct<role:string,content:string>>")
    done = repair.training_data_diagnosis(spark, str(tmp_path), rows, "n", step=2, limit=40)
    found = {r["task"]: r for r in done["counters"].frame.collect()}
    assert found[None]["rows"] == 12 == found["a"]["rows"] and found[None]["short_answer"] == 6
    assert found[None]["prefix_mismatch"] == 0 and 0 < found[None]["over_limit"] < 12 and found[None]["end_kept"] == 12 - found[None]["over_limit"]
    shown = done["examples"].frame.orderBy("task", "number").collect()
    assert [(r["task"], r["number"], r["provenance"]) for r in shown] == [("a", 1, "src0"), ("a", 2, "src2"), ("a", 3, "src4"), ("b", 1, "src1"), ("b", 2, "src3"), ("b", 3, "src5")]
    assert not any(r.fresh for r in repair.training_data_diagnosis(spark, str(tmp_path), rows, "n", step=2, limit=40).values())


def test_requests_are_checked_routed_and_answered(spark):
    say = lambda *turns: [{"role": r, "content": c} for r, c in turns]
    rows = [
        (1, "smart_repaired", say(("user", "请翻译“学而时习之”")), 64), (2, "smart_repaired", say(("system", "s"), ("user", "hello there")), 64), (3, "other", say(("user", "x")), 64), (4, "official_instruct", say(("user", "x"), ("assistant", "y")), 8),
        (5, "official_instruct", None, 64), (6, "translation_repaired", say(("user", "just this line")), 64), (7, "official_instruct", say(("user", "word " * 3000)), 64),
    ]
    df = spark.createDataFrame(rows, "id int, model string, messages array<struct<role:string,content:string>>, max_tokens int")
    loaders = {n: (lambda name: lambda: lambda prompts: [(f"{name}: {p}", 64 if "hello" in p else 3, True) for p in prompts])(n) for n in ("translation_repaired", "official_instruct")}
    got = {r.id: r for r in serving.replies(df, loaders).collect()}
    assert {i: r.backend for i, r in got.items()} == {1: "translation_repaired", 2: "official_instruct", 3: None, 4: None, 5: None, 6: "translation_repaired", 7: None}
    assert got[1].prompt == "原文：学而时习之\n译文：" and got[6].prompt == "原文：just this line\n译文：" and got[1].response == "translation_repaired: " + got[1].prompt
    assert got[2].prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhello there<|im_end|>\n<|im_start|>assistant\n"
    assert got[2].hit_limit and not got[1].hit_limit and got[3].response is None
    assert (got[3].errors, got[4].errors, got[5].errors, got[7].errors) == (["model"], ["last_role", "max_tokens"], got[5].errors, ["prompt_too_long"]) and "messages" in got[5].errors


def test_training_sets_and_run_metadata(spark, tmp_path):
    import json

    from lexiloom.sources import artifacts, registry

    (tmp_path / "t.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "v.jsonl").write_text('{"a": 3}\n')
    path = lambda n: str(tmp_path / n)
    assert set(registry.training_sets(spark, path("t.jsonl"), path("empty.jsonl"))) == {"train"} == set(registry.training_sets(spark, path("t.jsonl"), path("none.jsonl"))) == set(registry.training_sets(spark, path("t.jsonl")))
    both = registry.training_sets(spark, path("t.jsonl"), path("v.jsonl"))
    assert both["train"].count() == 2 and both["validation"].first().a == 3
    where = artifacts.save_run_metadata(spark, str(tmp_path), {"seed": 1}, "m", "complete", {"loss": 0.5})
    assert json.loads(open(where).read())["metrics"] == {"loss": 0.5}


def test_experiments_run_once_and_select(spark, tmp_path):
    variants = {"plain": {"stage": "sft", "data": "high", "learning_rate": 1e-5}, "pairs": {"stage": "dpo", "data": "high", "learning_rate": 5e-6, "beta": 0.1}}
    grid = experiments.run_grid(variants, [1, 2], "start", "/data", str(tmp_path / "out"))
    assert [c["name"] for c in grid] == ["plain-seed1", "plain-seed2", "pairs-seed1", "pairs-seed2"]
    assert grid[2]["reference_model_name_or_path"] == "start" and grid[2]["beta"] == 0.1 and grid[0]["max_seq_length"] == 512 and "beta" not in grid[0]
    with pytest.raises(ValueError, match="stage"):
        experiments.run_grid({"x": {"stage": "grpo", "data": "d"}}, [1], "m", "d", "o")
    trained = []

    def train(config):
        trained.append(config["name"])
        return f"{config['output_dir']}/best"

    def evaluate(path, config):
        good = config["stage"] == "dpo"
        rows = [(f"answer {i}", "source", True, not good, 0.01, 40.0 + config["seed"], 5, 0.9) for i in range(4)]
        return spark.createDataFrame(rows, "response string, source string, stopped boolean, replacement boolean, repetition double, chrf double, tokens int, general double")

    questions = spark.createDataFrame([(1,)], "id int")
    go = lambda gate: experiments.run_experiments(spark, str(tmp_path / "runs"), grid, train, evaluate, gate, questions)
    assert go(stats.capability_gate(0.9))["selected"].frame.first()["name"] == "pairs-seed2" and trained == [c["name"] for c in grid]
    assert go(stats.capability_gate(0.9))["selected"].facts == {"selected": "pairs-seed2"} and len(trained) == 4
    with pytest.raises(GateError):
        go(stats.capability_gate(1.5))
    assert len(trained) == 4
