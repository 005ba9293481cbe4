import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import rewards
from lexiloom.functions.hashing import group_key, stable_split
from lexiloom.operators import acquire, chat, dedup, judging, preferences, review, sampling, sft, stats, teacher, tokens
from lexiloom.plans import contract, contract_rules, corpus
from lexiloom.sources.shared import durable


def test_same_work_same_split_and_no_key_raises(spark):
    rows = spark.createDataFrame([("1", "w"), ("2", "w"), ("3", None)], "id string, work string")
    key = group_key({"work": F.col("work"), "id": F.col("id")})
    got = rows.select(key.alias("k"), stable_split(key, 7).alias("s")).collect()
    assert got[0]["s"] == got[1]["s"]
    assert got[2]["k"] == "id:3"
    with pytest.raises(Exception, match="no field"):
        rows.where("id = '3'").select(group_key({"work": F.col("work")})).collect()
    with pytest.raises(ValueError, match="shares"):
        stable_split(F.lit("x"), 1, 0.9, 0.2)


def test_prepare_keeps_one_of_three(spark):
    text = "子曰學而時習之不亦說乎有朋自遠方來不亦樂乎人不知而不慍不亦君子乎"
    rows = spark.createDataFrame([(1, "a", "classical", text), (2, "b", "classical", text + " "), (3, "c", "classical", "短")], "n long, work string, category string, text string")
    out = {r["n"]: r["reasons"] for r in corpus.prepare(rows, "n").collect()}
    assert out[1] == [] and out[2] == ["exact_duplicate"] and "too_short" in out[3]
    audit = {(r["kind"], r["name"]): r["rows"] for r in corpus.audit(corpus.prepare(rows, "n"), "work").collect()}
    assert audit["rejected", "exact_duplicate"] == 1


def test_long_text_with_one_edit_is_near_duplicate(spark):
    r = random.Random(3)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(10_000))
    rows = spark.createDataFrame([(1, "x", text), (2, "y", text[:5000] + "0123456789" + text[5010:])], "n long, k string, t string").withColumn("fp", dedup.simhash(F.col("t")))
    assert [x["duplicate_of_kind"] for x in dedup.keep_first(rows, "n", "k", "fp").orderBy("n").collect()] == [None, "near_duplicate"]


def greedy(rows, radius=3):
    """Rows ``n, key, fp`` decided one after the other."""
    kept, want = [], {}
    for n, k, fp in sorted(rows):
        if any(k == kk for _, kk, _ in kept):
            want[n] = "exact_duplicate"
        elif fp is not None and any(f is not None and bin((fp ^ f) & (2**64 - 1)).count("1") <= radius for _, _, f in kept):
            want[n] = "near_duplicate"
        else:
            want[n] = None
            kept.append((n, k, fp))
    return want


def test_fingerprints_by_hand(spark):
    """Bits counted one by one from the definition: trigrams, their hashes, the majority with ties set."""
    import hashlib

    def by_hand(text, first_bits):
        value = text if len(text) >= 3 else text + "_" * (3 - len(text))
        grams = [value[i : i + 3] for i in range(len(value) - 2)]
        if len(grams) > 512:
            grams = [grams[i * len(grams) // 512] for i in range(512)]
        hashes = [first_bits(g.encode()) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))

    little = lambda g: int.from_bytes(hashlib.blake2b(g, digest_size=8).digest(), "little")
    big = lambda g: int.from_bytes(hashlib.sha256(g).digest()[:8], "big")
    r = random.Random(2)
    texts = ["", "a", "ab", "abc", "abcd", "天地玄黄宇宙", "x" * 50, "".join(r.choice("abcdef 天地") for _ in range(2000)), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", dedup.simhash(F.col("t")).alias("b"), dedup.simhash(F.col("t"), "sha256").alias("s")).orderBy("n").collect()
    for row, text in zip(rows, texts, strict=True):
        if text is None:
            assert row["b"] is None and row["s"] is None
        else:
            assert row["b"] % (1 << 64) == by_hand(text, little) and row["s"] % (1 << 64) == by_hand(text, big)
    # pinned, worked out by the definition above
    assert rows[3]["b"] % (1 << 64) == little(b"abc") and rows[0]["b"] % (1 << 64) == little(b"___")
    whole = dedup.fingerprint("ab" * 2000, most=None)
    assert whole % (1 << 64) == little(b"aba") | little(b"bab") and len(dedup.trigrams("ab" * 2000, None)) == 3998


def test_greedy_over_blake2b_fingerprints(spark):
    r = random.Random(11)
    texts = []
    for k in range(12):
        base = [r.choice("abcdefghij") for _ in range(600)]
        for _ in range(5):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(600)] = r.choice("abcdefghij")
            texts.append("".join(copy))
    r.shuffle(texts)
    rows = [(n, t, dedup.fingerprint(t)) for n, t in enumerate(texts)]
    df = spark.createDataFrame([(n, t) for n, t, _ in rows], "n long, t string").select("n", F.col("t").alias("k"), dedup.simhash(F.col("t")).alias("fp"))
    got = {x["n"]: x["duplicate_of_kind"] for x in dedup.duplicate_kinds(df, "n", "k", "fp").collect()}
    assert got == greedy(rows) and {None, "near_duplicate"} <= set(got.values())


def test_a_chain_longer_than_any_number_of_rounds(spark, monkeypatch):
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for each in (30, 500_000):  # many ranges, one range
        monkeypatch.setattr(dedup, "EDGES_A_RANGE", each)
        assert {r["n"]: r["kept"] for r in dedup.first_independent(chain).collect()} == {n: n % 2 == 0 for n in range(401)}
    back = spark.createDataFrame([(0, 9), (9, 4), (4, 7), (2, 7), (7, 8)], "x long, y long").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    edges, kept = [(r["a"], r["b"]) for r in back.collect()], {}
    for n in sorted({n for e in edges for n in e}):
        kept[n] = not any(b == n and kept[a] for a, b in edges)
    assert {r["n"]: r["kept"] for r in dedup.first_independent(back).collect()} == kept
    assert dedup.first_independent(back.where("false")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_near_pairs_lose_none(spark, radius):
    r = random.Random(radius)
    fps = set()
    for _ in range(20):
        base = r.getrandbits(64)
        for _ in range(6):
            x = base
            for _ in range(r.randrange(7)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    rows = list(enumerate(x - (1 << 64) if x >> 63 else x for x in fps))
    want = {(i, j, d) for i, a in rows for j, b in rows if i < j for d in [bin((a ^ b) & (2**64 - 1)).count("1")] if d <= radius}
    df = spark.createDataFrame(rows, "n long, fp long")
    assert {tuple(x) for x in dedup.near_pairs(df, "n", "fp", radius).collect()} == want
    with pytest.raises(ValueError, match="missed"):
        dedup.near_pairs(df, "n", "fp", 6)


def test_near_links_lose_no_row_of_equal_fingerprint(spark):
    r = random.Random(8)
    base = r.getrandbits(63)
    rows = [(n, base ^ sum(1 << b for b in r.sample(range(63), r.choice([0, 0, 1, 2])))) for n in range(60)] + [(60 + n, r.getrandbits(63)) for n in range(10)] * 2 + [(80, None), (None, base)]
    links = [tuple(x) for x in dedup.near_links(spark.createDataFrame(rows, "n long, fp long"), "n", "fp").collect()]
    fps = {n: fp for n, fp in rows if n is not None and fp is not None}
    distance = lambda a, b: bin(fps[a] ^ fps[b]).count("1")
    assert len(set(links)) == len(links) and all(a < b and distance(a, b) == d <= 3 for a, b, d in links)
    # every pair within the radius, by brute force, follows from the links
    first = {n: n for n in fps} | {b: a for a, b, d in links if d == 0}
    paired = {(a, b) for a, b, _ in links}
    want = {(a, b) for a in fps for b in fps if a < b and distance(a, b) <= 3}
    assert {(a, b) for a in fps for b in fps if a < b and (first[a] == first[b] or tuple(sorted((first[a], first[b]))) in paired)} == want
    assert sum(d == 0 for _, _, d in links) == len(fps) - len(set(fps.values())) > 10


def test_blake2b_pairs_have_copies_and_whole_texts(spark, tmp_path):
    distance = _shifted_texts(tmp_path, spark)
    more = spark.read.parquet(f"{tmp_path}/documents.parquet")
    more.union(more.where("doc_id <> 2").selectExpr("doc_id + 10", "text", "lang", "source")).write.parquet(f"{tmp_path}/more/documents.parquet")
    assert sorted(map(tuple, contract.simhash_blake2b_pairs(spark, f"{tmp_path}/more").collect())) == sorted([(1, 11, 0), (1, 2, distance), (3, 13, 0)])


def test_near_pairs_are_not_broadcast(spark):
    pairs = dedup.near_pairs(spark.createDataFrame([(x, x) for x in range(40)], "n long, fp long"), "n", "fp")
    assert len(pairs.collect()) == sum(bin(a ^ b).count("1") <= 3 for a in range(40) for b in range(a))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("audit", [contract.prepare_audit, contract_rules.prepare_audit_sha256])
def test_audit_broadcasts_no_table_that_grows(spark, tmp_path, audit):
    df = spark.createDataFrame([(1, "Some words. " * 20, "en", "s"), (2, None, "en", "s"), (3, "short", "en", ""), (4, "Some words. " * 20, "en", "s"), (5, "Other things here. " * 20, "en", None)], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = audit(spark, str(tmp_path))
    got = {(r["kind"], r["name"]): r["rows"] for r in out.collect()}
    assert sum(n for (kind, _), n in got.items() if kind == "split") == 2
    assert {k: n for k, n in got.items() if k[0] != "split"} == {("source", "s"): 1, ("source", "unknown"): 1, ("rejected", "too_short"): 2, ("rejected", "repeated_lines"): 1, ("rejected", "exact_duplicate"): 1}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def _shifted_texts(folder, spark):
    """Documents 1 and 2 differ by a word in front, which moves every one of 512 evenly spaced trigrams; 3 is another text."""
    r = random.Random(5)
    one, other = (" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9))) for _ in range(2500)) for _ in range(2))
    df = spark.createDataFrame([(1, one, "en", "s"), (2, "Preface " + one, "en", "s"), (3, other, "en", "s")], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{folder}/documents.parquet")
    key = one.replace(" ", "")
    apart = lambda most: bin((dedup.fingerprint(key, most=most) ^ dedup.fingerprint("preface" + key, most=most)) & (2**64 - 1)).count("1")
    assert apart(None) <= dedup.RADIUS < apart(dedup.MAX_FEATURES)
    return apart(None)


def test_audit_fingerprints_whole_texts(spark, tmp_path):
    _shifted_texts(tmp_path, spark)
    got = {(r["kind"], r["name"]): r["rows"] for r in contract.prepare_audit(spark, str(tmp_path)).collect()}
    assert got["rejected", "near_duplicate"] == 1 and got["source", "s"] == 2


def test_decisions_are_not_broadcast(spark, monkeypatch):
    plans = []

    def spy(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df, label)

    monkeypatch.setattr(dedup, "durable", spy)
    monkeypatch.setattr(dedup, "EDGES_A_RANGE", 3)
    chain = dedup.first_independent(spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long"))
    assert {r["n"]: r["kept"] for r in chain.collect()} == {i: i % 2 == 0 for i in range(13)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_texts_are_normalised_once(spark, monkeypatch, tmp_path):
    plans = []

    def spy(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return durable(df, label)

    for module in (contract, corpus):
        monkeypatch.setattr(module, "durable", spy)
    df = spark.createDataFrame([(1, "Some words. " * 20, "en", "s"), (2, None, "en", "s"), (3, "short", "en", "s"), (4, "Some words. " * 20, "en", "s")], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(contract.near_dedup_keep_first(spark, str(tmp_path)).collect()) == [(1, None), (4, "exact_duplicate")]
    out = contract.prepare_corpus(spark, str(tmp_path))
    assert {r["doc_id"]: r["reasons"] for r in out.collect()} == {1: "", 2: "too_short,repeated_lines", 3: "too_short", 4: "exact_duplicate"}
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) == 3 and all(p.count("array_join(regexp") + p.count("array_join(transform") == 1 for p in plans)


def test_clashing_names_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 5, 1), (2, "a", 5, 1), (3, None, None, 1), (4, None, None, 1), (5, "b", None, 1)], "n long, k string, fp long, number int")
    wide = df.selectExpr("*", "1 key", "2 first", "3 kept", "4 head", "5 a", "6 b", "7 first_key")
    out = dedup.keep_first(wide, "n", "k", "fp")
    assert out.columns == [*wide.columns, "duplicate_of_kind"]
    assert {r["n"]: r["duplicate_of_kind"] for r in out.collect()} == {1: None, 2: "exact_duplicate", 3: None, 4: "exact_duplicate", 5: None}
    exact = dedup.exact_keep_first(wide, F.col("k"), F.col("n"))
    assert exact.columns == [*wide.columns, "is_duplicate"]
    assert {r["n"]: r["is_duplicate"] for r in exact.collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}
    assert dedup.keep_first(wide.where("false"), "n", "k", "fp").count() == dedup.exact_keep_first(wide.where("false"), F.col("k"), F.col("n")).count() == 0
    text = "A sentence that is long enough to pass the length rule of the general category, surely it is. "
    rows = spark.createDataFrame([(1, text, "general_en"), (2, None, None), (3, text, "general_en")], "n long, text string, category string").selectExpr("*", "'s' source_id", "1 number", "2 key", "3 fp", "4 __key", "5 __fp", "6 reasons")
    assert {r["n"]: r["reasons"] for r in corpus.prepare(rows, "n").collect()} == {1: [], 2: ["too_short", "repeated_lines", "low_cjk_ratio"], 3: ["exact_duplicate"]}
    assert corpus.prepare(rows.where("false"), "n").count() == 0


def test_missing_category_is_general_chinese(spark):
    rows = spark.createDataFrame([(1, "x", "English only text " * 10), (2, "y", "算法与定理" * 30 + "甲")], "n long, work string, text string")
    out = {r["n"]: r for r in corpus.prepare(rows, "n").collect()}
    assert out[1]["reasons"] == ["low_cjk_ratio"] and out[1]["category"] == "general_zh"
    assert out[2]["reasons"] == [] and out[2]["category"] == "stem_technical"


def test_evaluation_rows_as_defined(spark):
    m = lambda *turns: [(role, text) for role, text in turns]
    rows = [
        ("1", "test", "t", "p1", None, None, "out", "ans", None),
        ("2", "test", "t", None, "in2", None, None, "ans2", None),
        ("3", "test", "t", None, None, None, None, None, m(("system", "s"), ("user", "q"), ("user", "last"))),
        ("4", "test", "t", None, "", "r", None, None, m(("user", "q"), ("assistant", "a"))),
        ("5", "train", "t", "p", None, "r", None, None, None),
        ("6", "test", "t", "p1", None, "again", None, None, None),
    ]
    df = spark.createDataFrame(rows, f"id string, split string, task string, prompt string, input string, reference string, output string, answer string, messages {chat.MESSAGES}").withColumn("extra", F.lit(7))
    out = {r["prompt"]: r for r in corpus.evaluation_rows(df).collect()}
    assert {p: r["reference"] for p, r in out.items() if p in ("p1", "in2")} == {"p1": "out", "in2": "ans2"}
    (listed,) = [r for p, r in out.items() if p.startswith("[")]
    assert listed["reference"] == "last" and "last" not in listed["prompt"] and "system" in listed["prompt"]
    assert len(out) == 3 and all(r["extra"] == 7 and r["split"] == "test" for r in out.values())


def test_perplexity_sets_take_every_row(spark):
    df = spark.createDataFrame([(str(i), c, "text", s) for i, (c, s) in enumerate([("classical", None), ("general_zh", "train"), ("general_en", "test"), ("other", "test")])], "id string, category string, text string, split string")
    assert {r["id"] for r in corpus.perplexity_sets(df, 5).collect()} == {"0", "1", "2"}


def test_sft_defaults(spark):
    df = spark.createDataFrame([("r1", "old_to_modern", "古文甲乙丙丁", "今文甲乙丙丁戊", "book")], "id string, task string, input string, output string, source string").withColumn("n", F.lit(1))
    row = sft.candidates(df, "n").first()
    assert (row["source_id"], row["license"], row["provenance"], row["split"]) == ("r1", "unknown", "book", "train")
    assert sft.candidates(df.drop("source"), "n", origin="file.jsonl").first()["provenance"] == "file.jsonl"
    assert len(sft.build(df, "n", 1, {"old_to_modern": 1}).collect()) == 1  # rows without a split fill the train quota
    own = sft.candidates(df, "n", templates={"old_to_modern": ["<{text}>"]}, system="S").first()["messages"]
    assert own[1]["content"] == "<古文甲乙丙丁>" and own[0]["content"] == "S"


def test_bias_report_as_defined(spark):
    shown = spark.createDataFrame([(f"t:p{i}:{o}", f"p{i}", o, "chosen" if o == 0 else "rejected", "rejected" if o == 0 else "chosen") for i in range(3) for o in (0, 1)], "presentation_id string, pair_id string, order int, option_a_role string, option_b_role string")
    high, low, none = (9.0, 2.0, 1.0, 0.0), (1.0, 2.0, 1.0, 1.0), (None, 2.0, 1.0, 1.0)
    said = [("t:p0:0", ("A", high, low, "because")), ("t:p0:1", (" b ", low, high, "x")), ("t:p1:0", ("A", high, low, "x")), ("t:p1:1", ("A", high, low, "")), ("t:p2:0", (None, none, low, "so")), ("t:p2:1", ("C", high, high, "so"))]
    report = judging.position_bias(spark.createDataFrame(said, f"presentation_id string, judge {judging.JUDGE}"), shown)
    schema = report["schema"].first()
    # C is no winner and one score is missing; a missing winner and a score of nine are no violations
    assert schema["schema_violations"] == 2 and schema["spurious_c"] == 1 and schema["missing_reason_rate"] == pytest.approx(1 / 6)
    pairs = lambda name: {r["pattern"]: r["pairs"] for r in report[name].collect()}
    assert pairs("pair_patterns") == {"A/B": 1, "A/A": 1, "INVALID/C": 1}
    assert pairs("patterns") == {"chosen/chosen": 1, "chosen/rejected": 1, "invalid/invalid": 1}
    assert pairs("score_patterns") == {"chosen/chosen": 1, "chosen/rejected": 1, "invalid/tie": 1}
    assert report["score_consistency"].first()["position_consistency"] == pytest.approx(1 / 3)
    assert [(r["pair_id"], r["winner_roles"], r["reasons"]) for r in report["examples"].collect()] == [("p1", ["chosen", "rejected"], ["x", ""])]
    assert {(r["order"], r["role"]): r["rows"] for r in report["roles_by_order"].collect()}[0, "chosen"] == 2


def test_incomplete_reviews_are_skipped_before_ranges(spark):
    key = spark.createDataFrame([("b1", "m"), ("b2", "m")], "blind_id string, model string")
    sheet = spark.createDataFrame([("b1", "t", {"a": 9, "b": None}), ("b2", "t", {"a": 4, "b": 2})], "blind_id string, task string, scores map<string,int>")
    total = review.review_summary(sheet, key).where("task is null").first()
    assert total["incomplete"] == 1 and total["mean"] == 3.0
    gens = spark.createDataFrame([("m", str(i), t, "p", "r", "g") for i, t in enumerate([*review.DIMENSIONS, "other"])], "model string, id string, task string, prompt string, response string, reference string")
    blank = {r["task"]: set(r["scores"]) for r in review.blind(gens, 1, review.DIMENSIONS)[0].collect()}
    assert blank == {t: set(d) for t, d in review.DIMENSIONS.items()} | {"other": set()}


def test_splits_leave_a_test_part():
    for train, validation in ((0.9, 0.1), (0.0, 0.5), (0.5, -0.1)):
        with pytest.raises(ValueError, match="shares"):
            stable_split(F.lit("x"), 1, train, validation)


def test_library_tokenizers_and_text_of_mixtures(spark):
    load = lambda: (lambda t: list(t), lambda t: "".join(t))
    rows = spark.createDataFrame([(i, "a", f"text {i}") for i in range(10)], "source_id long, category string, text string")
    mixed = corpus.mixture(rows, {"a": 1.0}, 60, tokenizer=tokens.library_tokenizer(load)).collect()
    assert sum(r["token_count"] for r in mixed) == 60 and all(r["text"] == "".join(r["tokens"]) for r in mixed)
    whole = [r["text"] for r in mixed if r["token_count"] == 7]
    assert set(whole) <= {f"text {i}" for i in range(10)} and len(whole) >= 7


def test_mixture_equals_a_sequential_fill(spark):
    import hashlib

    rows = [(f"k{i}", "ab"[i % 2], ["t"] * (1 + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, category string, tokens array<string>").withColumn("hash", F.lit(1)).withColumn("key", F.lit(2))
    got = {(r["category"], r["k"], r["mixture_epoch"]): r["token_count"] for r in tokens.token_mixture(df, {"a": 0.6, "b": 0.4}, 400, 3, "k").collect()}
    want = {}
    for c, quota in (("a", 240), ("b", 160)):
        left = quota
        for epoch in (0, 1):
            for k, t in sorted(((k, t) for k, own, t in rows if own == c), key=lambda x: (hashlib.sha256(f"3:{epoch}:{x[0]}".encode()).hexdigest(), x[0])):
                if left > 0:
                    want[c, k, epoch] = min(left, len(t) + 1)
                    left -= want[c, k, epoch]
    assert got == want


def test_bootstrap_draws_with_replacement(spark):
    values = [1.0, 2.0, 4.0, 8.0, None]
    df = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)], "id string, delta double")
    mixed = lambda x: stats._mixed(stats.np.array([x], dtype=stats.np.uint64))[0]
    means = sorted(sum(values[int(mixed(7 + r * 4 + j)) % 4] for j in range(4)) / 4 for r in range(200))
    got = stats.bootstrap_ci(df, "id", 7, 200).first()
    at = lambda q: means[int(199 * q)] + (199 * q % 1) * (means[int(199 * q) + 1] - means[int(199 * q)])
    assert got["mean"] == 3.75 and got["low"] == pytest.approx(at(0.025)) and got["high"] == pytest.approx(at(0.975))
    assert tuple(stats.bootstrap_ci(df.where("false"), "id", 7, 10).first()) == (None, None, None)
    many = spark.createDataFrame([(f"k{i}", values[i % 4]) for i in range(400)], "id string, delta double")
    near = stats.bootstrap_ci(many, "id", 7, 2000).first()
    far = stats.bootstrap_ci(many, "id", 7, 2000, leaf_size=3).first()
    assert far["mean"] == 3.75 and abs(far["low"] - near["low"]) < 0.1 and abs(far["high"] - near["high"]) < 0.1
    # neither partitions nor the order of rows change it, at one leaf or many
    again = many.orderBy(F.rand(1)).repartition(7)
    assert tuple(stats.bootstrap_ci(again, "id", 7, 2000, leaf_size=3).first()) == pytest.approx(tuple(far))
    assert tuple(stats.bootstrap_ci(again, "id", 7, 2000).first()) == pytest.approx(tuple(near))


@pytest.mark.parametrize(("n", "size"), [(1, 1), (10, 3), (64, 8), (101, 7), (5, 100)])
def test_draws_of_all_leaves_are_multinomial(n, size):
    samples, leaves = 4000, -(-n // size)
    draws = stats.np.array([stats.leaf_draws(n, k, size, 3, samples) for k in range(leaves)])
    assert (draws.sum(axis=0) == n).all() and (draws >= 0).all()
    rows = stats.np.array([min(size, n - k * size) for k in range(leaves)])
    share = rows / n
    assert stats.np.allclose(draws.mean(axis=1), rows, atol=6 * (n * 0.25 / samples) ** 0.5)
    want = n * share * (1 - share)  # variance of a multinomial's parts
    assert stats.np.allclose(draws.var(axis=1), want, rtol=0.15, atol=0.05)
    if leaves > 2:
        assert abs(stats.np.cov(draws[0], draws[1])[0, 1] + n * share[0] * share[1]) < 0.15 * n * share[0]


def test_nothing_changes_the_session(spark):
    before = {k: v for k, v in spark.conf.getAll.items()} if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "n long, k string, fp long")
    dedup.keep_first(rows, "n", "k", "fp").collect()
    sampling.round_robin(rows, ["x"], ["n"]).collect()
    assert dict(spark.conf.getAll if not callable(spark.conf.getAll) else spark.conf.getAll()) == before


def test_keep_first_equals_sequential_greedy(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = []
    for n in range(150):
        fp = r.choice(base)
        for _ in range(r.randrange(5)):
            fp ^= 1 << r.randrange(64)
        rows.append((n, f"k{fp}", fp - (1 << 64) if fp >> 63 else fp))
    df = spark.createDataFrame(rows, "n long, k string, fp long")
    assert {x["n"]: x["duplicate_of_kind"] for x in dedup.keep_first(df, "n", "k", "fp").collect()} == greedy(rows)


def test_task_rules_in_order(spark):
    rows = spark.createDataFrame([("请翻译成文言文", ""), ("把下文译为白话", ""), ("对联", "x"), ("", "firefly_Couplet"), ("赏析此诗", ""), ("说说成语", "")], "i string, t string")
    got = [r["x"] for r in rows.select(acquire.classify_instruction(F.col("i"), F.col("t")).alias("x")).collect()]
    assert got == ["modern_to_old", "old_to_modern", "creation", "creation", "appreciation", None]


def test_acquire_records_a_failing_source_and_goes_on(spark):
    def load(s):
        if s.name == "bad":
            raise OSError("gone")
        return spark.createDataFrame([(0, "甲", "乙", "w"), (1, " ", "乙", "w")], "n long, classical string, modern string, work string")

    sources = [acquire.Source("bad", "json", "x", "classical"), acquire.Source("good", "json", "y", "classical", mode="translation_pair"), acquire.Source("off", "json", "z", "c", enabled=False)]
    frames, report = acquire.acquire(spark, sources, load, "n", 1)
    rows = frames["good"].collect()
    assert {(r["task"], r["input"], r["output"]) for r in rows} == {("old_to_modern", "甲", "乙"), ("modern_to_old", "乙", "甲")}
    assert len({r["split"] for r in rows}) == 1
    assert {r["name"]: (r["rows"], r["error"]) for r in report.collect()} == {"bad": (0, "gone"), "good": (2, None)}


def test_poems_join_last_analysis(spark):
    poems = spark.createDataFrame([(0, "1", "床前明月光"), (1, "2", "x")], "n long, id string, text string")
    notes = spark.createDataFrame([(0, 1, "a", "", None, "b", "c"), (1, 1, "d", "", None, "", "e")], "o long, id long, intent string, subject string, theme string, thought string, emotion string")
    out = acquire.poetry_appreciation(poems, notes, acquire.Source("p", "json", "p", "classical"), "n", "o", 1)
    assert {(r["analysis_aspect"], r["output"]) for r in out.collect()} == {("intent", "d"), ("emotion", "e")}


def test_sft_quota_and_wrapping(spark):
    rows = [(i, f"s{i}", t, f"古文{i}甲乙丙", f"今文{i}甲乙丙丁", "train", "") for i, t in enumerate(sft.TASKS)] + [(9, "s9", "old_to_modern", "指令已有甲乙", "回答丙丁戊己", "train", "已有指令")]
    df = spark.createDataFrame(rows, "n long, source_id string, task string, input string, output string, split string, instruction string")
    built = sft.build(df, "n", 1, dict.fromkeys(sft.TASKS, 1)).collect()
    assert sorted(r["task"] for r in built) == sorted(sft.TASKS)
    kept = {r["source_id"]: r["messages"] for r in sft.candidates(df, "n").collect()}
    assert kept["s9"][1]["content"] == "指令已有甲乙"
    assert kept["s0"][1]["content"].endswith("古文0甲乙丙") and kept["s0"][1]["content"] != "古文0甲乙丙"
    with pytest.raises(sampling.QuotaError):
        sft.build(df, "n", 1, {"creation": 2})
    pairs = preferences.build(sft.candidates(df, "n"), 1).collect()
    assert len(pairs) == 5 and all(p["chosen"] != p["rejected"] for p in pairs)


def test_corruptions(spark):
    rows = spark.createDataFrame([("不可三人。再行。", "modern_to_old"), ("ab", "old_to_modern"), ("x", "appreciation")], "a string, t string")
    got = [[(o["text"], o["error"]) for o in r["o"]] for r in rows.select(preferences.corruptions(F.col("a"), F.col("t")).alias("o")).collect()]
    assert ("可三人。再行。", "wrong_negation") in got[0] and ("不可五人。再行。", "wrong_number") in got[0] and ("不可三人。", "omission") in got[0]
    assert got[1] == [("a。", "truncation")]
    assert got[2][0][1] == "unsupported_appreciation"


def test_chat_templates_and_no_gold(spark):
    m = spark.createDataFrame([([("user", "q"), ("assistant", "gold")],), ([("assistant", "only")],), ([],)], f"m {chat.MESSAGES}")
    rows = m.select(chat.prompt_text(F.col("m")).alias("p"), chat.reference_text(F.col("m")).alias("r"), chat.render(F.col("m"), assistant_end="<|endoftext|>").alias("e"), chat.render(F.col("m"), default_system="s").alias("d")).collect()
    assert "gold" not in rows[0]["p"] and rows[0]["p"].endswith("assistant\n") and [r["r"] for r in rows] == ["gold", "only", ""]
    assert "q<|im_end|>" in rows[0]["e"] and "gold<|endoftext|>" in rows[0]["e"]
    assert rows[0]["d"].startswith("<|im_start|>system\ns")
    with pytest.raises(ValueError, match="end token"):
        chat.render(F.col("m"), assistant_end="</s>")
    bad = m.select(chat.payload_errors(F.col("m"), F.lit(1)).alias("x")).collect()
    assert set(bad[2]["x"]) == {"messages", "last_role", "max_tokens"}


def test_mixture_is_exact_and_packing_keeps_all_tokens(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", " ".join(f"w{j}" for j in range(5 + i))) for i in range(40)], "n long, category string, text string")
    df = rows.withColumn("tokens", tokens.simple_tokens(F.col("text")))
    mixed = tokens.token_mixture(tokens.chunk(df, "tokens", "n", 8).withColumn("cid", F.concat_ws("#", F.col("n").cast("string"), F.col("chunk_index").cast("string"))), {"a": 0.25, "b": 0.75}, 400, 1, "cid")
    assert {r["category"]: r["tokens"] for r in tokens.mixture_manifest(mixed).collect()} == {"a": 100, "b": 300}
    with pytest.raises(sampling.QuotaError):
        tokens.token_mixture(df, {"a": 1.0}, 10**6, 1, "n")
    with pytest.raises(ValueError, match="sum"):
        tokens.token_mixture(df, {"a": 0.5}, 10, 1, "n")
    blocks = tokens.pack_blocks(df.withColumn("g", F.lit(0)), "tokens", "n", 16, "g", least=1).orderBy("block_index").collect()
    joined = [t for b in blocks for t in b["tokens"]]
    assert joined == [t for r in df.orderBy("n").collect() for t in [*r["tokens"], "<eos>"]] and {len(b["tokens"]) for b in blocks[:-1]} == {16}


def test_sampling(spark):
    df = spark.range(1000).withColumn("score", (F.col("id") % 50).cast("double")).withColumn("band", sampling.difficulty(F.col("score")))
    picked = sampling.stratified(df, "band", 100, 1, "id")
    assert picked.count() == 100 and picked.select("id").distinct().count() == 100
    assert [r["id"] for r in sampling.every_nth(df, 100, ["id"]).orderBy("id").collect()] == list(range(0, 1000, 100))
    turns = sampling.round_robin(df.limit(10), ["x", "y", "z"], ["id"]).orderBy("id").collect()
    assert [r["task"] for r in turns] == (["x", "y", "z"] * 4)[:10]
    with pytest.raises(sampling.QuotaError):
        sampling.balanced(df, "band", ["low", "none"], 1, 1, "id")


def test_rewards(spark):
    rows = spark.createDataFrame([("三人行，不可失。此为译文。", "三人行，不可失。", "三人行，不可失。此为译文。"), ("五人行，可失也。", "三人行，不可失。", "其他文字全然不同无关者也")], "c string, s string, r string")
    c = {"completion": F.col("c"), "source": F.col("s"), "reference": F.col("r"), "task": F.lit("modern_to_old")}
    got = rows.select(*(rewards.REGISTRY[n](**c).alias(n) for n in ("nonempty", "reference_chrf", "critical_token", "reference_length", "source_copy_penalty"))).collect()
    assert got[0]["reference_chrf"] == 1.0 and got[0]["critical_token"] == 1.0 and got[0]["reference_length"] == 1.0
    assert got[1]["critical_token"] < 0
    copy = rows.select(rewards.source_copy_penalty(completion=F.col("s"), source=F.col("s")).alias("x")).first()["x"]
    assert copy == -1.0
    with pytest.raises(ValueError, match="lacks"):
        rewards.weighted(["reference_chrf"], [1.0], completion=F.col("c"))
    with pytest.raises(ValueError, match="weights"):
        rewards.weighted(["nonempty"], [1.0, 2.0], completion=F.col("c"))


def test_swapped_judgments_merge(spark):
    pairs = spark.createDataFrame([("p", "s", "train", "good answer", "bad answer")], "id string, source_id string, split string, chosen string, rejected string")
    shown = judging.presentations(pairs, 1)
    high, low = (4.0, 4.0, 2.0, 0.0), (1.0, 2.0, 2.0, 1.0)
    said = [(r["presentation_id"], ("A" if r["option_a_role"] == "chosen" else "B", high if r["option_a_role"] == "chosen" else low, low if r["option_a_role"] == "chosen" else high, "ok")) for r in shown.collect()]
    verdict = judging.verdicts(spark.createDataFrame(said, f"presentation_id string, judge {judging.JUDGE}"), shown).first()
    assert verdict["high_confidence"] and verdict["position_consistent"] and list(verdict["winner_roles"]) == ["chosen", "chosen"]
    u = spark.createDataFrame([(high, low), (high, high), ((5.0, 1.0, 1.0, 0.0), low)], f"a {judging.SCORES}, b {judging.SCORES}").select(judging.compare(judging.utility(F.col("a")), judging.utility(F.col("b")), F.lit("a"), F.lit("b")).alias("w"))
    assert [r["w"] for r in u.collect()] == ["a", "tie", "invalid"]
    raw = spark.createDataFrame([('x {"winner": "A", "a": {"faithfulness": 1}} y',), ("none",)], "r string").select(judging.parse_pairwise(F.col("r")).alias("j")).collect()
    assert raw[0]["j"]["winner"] == "A" and raw[1]["j"] is None


def test_review_round_trip(spark):
    rows = spark.createDataFrame([("m", "q1", "t", "question", "answer", "gold")], "model string, id string, task string, prompt string, response string, reference string")
    sheet, key = review.blind(rows, 1, ["a", "b", "c"])
    assert "model" not in sheet.columns
    filled = sheet.withColumn("scores", F.create_map(F.lit("a"), F.lit(4), F.lit("b"), F.lit(3), F.lit("c"), F.lit(5)))
    assert {(r["task"], r["mean"]) for r in review.review_summary(filled, key).collect()} == {(None, 4.0), ("t", 4.0)}
    assert review.review_summary(sheet, key).where("task is null").first()["incomplete"] == 1
    with pytest.raises(Exception, match="out of range"):
        review.review_summary(sheet.withColumn("scores", F.create_map(F.lit("a"), F.lit(9))), key).collect()
    got = spark.createDataFrame([("甲。乙", 2, ["甲", "丙"]), ("x", None, None)], "r string, n int, k array<string>").select(review.constraint_score(F.col("r"), F.col("n"), F.col("k")).alias("x")).collect()
    assert got[0]["x"] == pytest.approx(2 / 3) and got[1]["x"] is None


def test_teacher_rules(spark):
    classical = "子曰學而時習之不亦說乎有朋自遠方來"
    rows = spark.createDataFrame([("classical", classical), ("web", "English web text")], "c string, t string")
    assert [r["x"] for r in rows.select(teacher.is_classical(F.col("c"), F.col("t")).alias("x")).collect()] == [True, False]
    answers = spark.createDataFrame([("appreciation", "“學而時習之”一句" + "說明道理" * 6, classical), ("appreciation", "generic praise with no quote at all", classical), ("creation", "x" * 30 + classical[:8], classical), ("creation", "", "")], "k string, a string, p string")
    assert [r["x"] for r in answers.select(teacher.rejections(F.col("k"), F.col("a"), F.col("p")).alias("x")).collect()] == [[], ["no_textual_overlap"], ["copied_eight_char_span"], ["answer_too_short"]]


def test_statistics(spark):
    a = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "id long, v double")
    d = stats.paired(a, a.withColumn("v", F.col("v") - 0.5), "id", "v", 50)
    assert stats.win_tie_loss(d).first().asDict() == {"mean_delta": 0.5, "wins": 50, "ties": 0, "losses": 0}
    ci = stats.bootstrap_ci(a.select("id", F.col("v").alias("delta")), "id", 1, 400).first()
    assert ci["low"] < ci["mean"] < ci["high"] and 0.3 < ci["high"] - ci["low"] < 1.3
    with pytest.raises(stats.GateError):
        stats.paired(a, a, "id", "v", 51)
    assert stats.seeds(a.limit(1).withColumn("g", F.lit("x")), "g", "v").first()["stdev"] == 0.0
    with pytest.raises(Exception, match="no metric"):
        sampling.argmin(spark.createDataFrame([("a", None)], "n string, m double"), "m", "n").collect()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 é学，\t\n\r\x0b\u3000"), max_size=40))
def test_pieces_make_the_text(text):
    import re

    found = re.findall(r"\s*(?:[A-Za-z0-9]+|[^A-Za-z0-9\s])(?:\s+\Z)?", text, re.ASCII)
    assert not found or "".join(found) == text


def test_native_pieces_chunks_and_offsets(spark):
    texts = [" 学而时习之，  不亦说乎 abc def\n ", "a", "", None, "   ", "x" * 50 + " \n\n y\n", "one two  three\u3000four " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumns({"tokens": tokens.SIMPLE.encode(F.col("text")), "pieces": tokens.SIMPLE.pieces(F.col("text"))})
    assert all(len(r.tokens or []) == len(r.pieces or []) for r in df.collect())
    cut = tokens.chunk(df.withColumns({"at": F.lit(1), "sizes": F.lit(2), "span": F.lit(3)}), "tokens", "id", 3, "pieces").orderBy("id", "chunk_index").collect()
    for i, text in enumerate(texts):
        mine = [r for r in cut if r.id == i]
        assert "".join("".join(r.pieces) for r in mine) == (text if text and text.strip() else "")
        assert all(text[r.text_start : r.text_end] == "".join(r.pieces) for r in mine)
        assert [r["at"] for r in mine] == [1] * len(mine)


def test_mixtures_fill_quotas_where_parents_and_rows_repeat(spark):
    rows = [("p", "same", "c", "学而时习之 a b")] * 20 + [(None, f"d{i}", "c", f"x{i} y z") for i in range(5)]
    df = spark.createDataFrame(rows, "source_id string, id string, category string, text string").repartition(3)
    for total in (50, 51, 77):
        got = corpus.mixture(df, {"c": 1.0}, total, most=4).collect()
        assert sum(r.token_count for r in got) == total
        assert all(len(r.tokens) == r.token_count - 1 for r in got)
    assert {r.parent_source_id for r in got} == {"p", *[f"d{i}" for i in range(5) if any(r.id == f"d{i}" for r in got)]}
    whole = [r for r in got if r.parent_source_id == "p" and r.token_count == 5 - r.chunk_index]
    assert whole and all(r.text == ("学而时习", "之 a b")[r.chunk_index] for r in whole) and all(r.text_end - r.text_start == len(r.text) for r in got)
    with pytest.raises(Exception, match="no source_id and no id"):
        corpus.mixture(df.drop("source_id", "id"), {"c": 1.0}, 50).collect()
    with pytest.raises(ValueError, match="several rows"):
        tokens.token_mixture(df.withColumn("tokens", tokens.simple_tokens(F.col("text"))), {"c": 1.0}, 50, 1, "id")


def test_library_tokenizers_with_offsets_keep_the_text(spark):
    def load():
        import re

        return lambda t: re.findall(r"\w+", t), lambda ts: "|".join(ts), lambda t: [m.span() for m in re.finditer(r"\w+", t)]

    df = spark.createDataFrame([("p", "c", "  one, two;  three!  ")], "id string, category string, text string")
    got = corpus.mixture(df, {"c": 1.0}, 4, tokenizer=tokens.library_tokenizer(load)).first()
    assert got.text == "  one, two;  three!  " and got.tokens == ["one", "two", "three"]
    assert corpus.mixture(df, {"c": 1.0}, 3, tokenizer=tokens.library_tokenizer(load)).first().text == "  one, two"
    bare = tokens.library_tokenizer(lambda: load()[:2])
    assert corpus.mixture(df, {"c": 1.0}, 4, tokenizer=bare).first().text == "one|two|three"
