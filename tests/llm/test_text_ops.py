"""Substring, suffix, decontamination, language and near-duplicate operators against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, exchange, graph, langid, simhash_dedup, substring_dedup, suffix_dedup, wordhash

ODD = [None, "", "   \n\t ", "one", "x " * 40, "a\x0bb\x0cc", "né à ö", " nbsp kept", "w" * 5000, "same same same " * 30]
CLASH = "doc_id long, text string, block long, owner string, n int, fp long, pass string, component_id int"


def corpus(seed=1, n=60):
    """Random documents with shared passages, copies, odd texts, repeated rows and ids."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    shared = [" ".join(word() for _ in range(k)) for k in (13, 14, 30, 50, 51, 60, 90)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 60)))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(shared), " ".join(word() for _ in range(r.randint(0, 20)))]
        docs.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    docs += [(n + i, t) for i, t in enumerate(ODD)] + [(n + 20, docs[0][1]), (n + 21, docs[0][1]), (3, docs[3][1]), (3, "other " * 20), (None, docs[1][1])]
    r.shuffle(docs)
    return docs


def frame(spark, docs):
    rows = [(i, t, 1, "o", 2, 3, "p", 4) for i, t in docs]
    return spark.createDataFrame(rows, CLASH).repartition(3)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def firsts(docs, size):
    first = {}
    for i, t in docs:
        if i is None:
            continue
        w = words(t)
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i)
    return first


@pytest.mark.parametrize("block", [200, 1 << 21])
def test_substring_dedup(spark, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "pack", lambda df, i, t: pack(df, i, t, block))
    docs = corpus()
    first = firsts(docs, 13)
    want = []
    for i, t in docs:
        w, gone = words(t), set()
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substring_dedup.remove_repeats(frame(spark, docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


from lexiloom.llm.blocks import pack  # noqa: E402


def test_two_levels_of_exchange_give_the_same(spark, monkeypatch):
    """Many ranges: blocks send few blobs, and what comes back is what one level gives."""
    docs = corpus(1)
    df = frame(spark, docs)
    monkeypatch.setattr(substring_dedup, "pack", lambda df, i, t: pack(df, i, t, 600))
    monkeypatch.setattr(suffix_dedup, "pack", lambda df, i, t: pack(df, i, t, 600))
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    one = [sorted(map(str, f(df).collect())) for f in (substring_dedup.remove_repeats, suffix_dedup.repeated_spans)]
    monkeypatch.setattr(exchange, "FAN", 5)
    monkeypatch.setattr(exchange, "RANGE_ENTRIES", 100)
    monkeypatch.setattr(exchange, "BLOB_KEYS", 2)
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 600)
    monkeypatch.setattr(suffix_dedup, "RANGE_SUFFIXES", 20)
    assert exchange.ranges_for(df, 2500, 0, 15_000).sub > 1 < exchange.ranges_for(df, 2500, 0, 15_000).teams
    assert [sorted(map(str, f(df).collect())) for f in (substring_dedup.remove_repeats, suffix_dedup.repeated_spans)] == one


def test_blobs_of_a_block_are_bounded(spark):
    entries = 100_000 * exchange.RANGE_ENTRIES
    ranges = exchange.ranges_for(spark.range(1), entries, 0, 6 * entries)
    assert ranges.coarse * ranges.sub >= 100_000 and ranges.coarse <= exchange.FAN
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 300_000, dtype=np.uint64))
    assert sum(1 for _ in exchange.deal(0, keys, [], ranges.coarse)) <= exchange.FAN
    # a team's keys for a coarse range suffice for its fine ones
    a_block = 300_000 / ranges.coarse
    assert a_block * (6 * entries / exchange.BLOCK_BYTES) / ranges.teams >= 0.5 * exchange.BLOB_KEYS * ranges.sub


def test_substring_filter_keeps_columns_and_clean_texts(spark):
    docs = corpus(2)
    df = frame(spark, docs).withColumnsRenamed({"block": "Id", "owner": "hash", "n": "kept", "fp": "id_"})
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns
    assert substring_dedup.without_repeats(df.where("false")).count() == 0
    cut = {(r["doc_id"], r["text_hash"]): r for r in substring_dedup.remove_repeats(df).collect()}
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = Counter()
    for i, t in docs:
        r = cut.get((i, (xxhash.xxh64_intdigest((t or "").encode(), 42) ^ 1 << 63) - (1 << 63)))
        if r is None or r["n_removed"] == 0:
            want[i, t] += 1
        elif r["n_removed"] < r["n_words"]:
            want[i, bytes(r["kept"]).decode()] += 1
    assert kept == want


@pytest.mark.parametrize("hot", [0, 3, 1024])
def test_suffix_spans(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # all, some or none of the beginnings by digests
    docs = corpus(3)
    first = firsts(docs, 50)
    want = set()
    for i, t in docs:
        w = words(t)
        if i is None:
            continue
        run = None
        for p in range(len(w) - 49 + 1):
            f = first.get(tuple(w[p : p + 50])) if p <= len(w) - 50 else None
            f = f if f is not None and f < i else None
            if run and run[0] == f and f is not None:
                run = (f, run[1], p)
            else:
                if run:
                    want.add((i, run[0], run[1], run[2] - run[1] + 50))
                run = (f, p, p) if f is not None else None
        if run:
            want.add((i, run[0], run[1], run[2] - run[1] + 50))
    df = frame(spark, docs)
    spans = suffix_dedup.repeated_spans(df)
    got = {(r["doc_id"], r["first_doc_id"], r["start_word"], r["n_words"]) for r in spans.collect()}
    assert got == want and got
    removed = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_spans(df.where("doc_id <> 3"), spans).collect()}
    clean = next(i for i, t in docs if i not in (None, 3) and i not in {x[0] for x in want} and words(t))
    assert removed[clean] == " ".join(words(dict(docs)[clean]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 12))
def test_sliding_argmin(values, width):
    got = suffix_dedup.sliding_argmin(np.array(values, dtype=np.uint64), width).tolist()
    assert got == [p + values[p : p + width].index(min(values[p : p + width])) for p in range(len(values) - width + 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(1, 2), min_size=4, max_size=4)), max_size=20))
def test_common_prefixes_of_sorted_neighbours(rows):
    group, words = np.array([g for g, _ in rows], dtype=np.int64), np.array([w for _, w in rows], dtype=np.uint64).reshape(-1, 4)
    order, common = suffix_dedup.common_prefixes(words, group)
    ranked = [rows[i] for i in order.tolist()]
    assert ranked == sorted(rows)
    for (g, a), (h, b), n in zip(ranked, ranked[1:], common[1:].tolist()):
        assert n == (-1 if g != h else next((k for k in range(4) if a[k] != b[k]), 4))
    assert not len(common) or common[0] == -1


def test_matches_are_extended_to_both_sides(spark):
    """One shared passage with own words around it: runs reach as far as it does, on either side, and no further."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    for size in (49, 50, 51, 75, 120, 400):
        passage = [word() for _ in range(size)]
        docs = [(k, " ".join([word() for _ in range(10 * k)] + passage + [word() for _ in range(7)])) for k in (1, 2, 3)]
        got = sorted(map(tuple, suffix_dedup.repeated_spans(frame(spark, docs)).collect()))
        assert got == ([(2, 1, 20, size), (3, 1, 30, size)] if size >= 50 else [])


def test_a_text_beyond_a_block(spark):
    r = random.Random(6)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(600_000))  # 4 MB
    docs = [(1, long), (2, " ".join(long.split()[500_000:500_100]))]
    assert sorted(map(tuple, suffix_dedup.repeated_spans(frame(spark, docs)).collect())) == [(2, 1, 0, 100)]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert got == {1: (600_000, 0), 2: (100, 100)}
    assert simhash_dedup.fingerprints(frame(spark, docs)).where("doc_id = 1").first()["fp"] % (1 << 64) == simhash_dedup.fingerprint(long)
    items = spark.createDataFrame([(7, docs[1][1])], "item_id long, text string")
    assert [(x["doc_id"], x["start_word"]) for x in decontaminate.contaminated(frame(spark, docs), items).orderBy("doc_id").collect()] == [(1, 500_000), (2, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], CLASH)
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.distinct_documents(none).count() == 0 and simhash_dedup.distinct_documents(none.withColumn("gone_id", F.lit(1))).columns == [*none.columns, "gone_id"]
    assert substring_dedup.without_repeats(none).count() == 0
    assert decontaminate.clean_documents(none, items).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    one = frame(spark, [(1, "text here")])
    assert decontaminate.contaminated(one, items).count() == 0
    assert substring_dedup.remove_repeats(frame(spark, [(1, None)])).first()["n_words"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=12), max_size=30))
def test_word_hashes_follow_words(parts):
    raw = b" ".join(parts)
    buf = np.frombuffer(raw, np.uint8)
    starts, ends = wordhash.word_bounds(buf)
    own = raw.split()
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == own
    for lane in (0, 1):
        h = wordhash.word_hashes(buf, starts, ends, lane).tolist()
        assert len(set(zip(own, h, strict=True))) == len(set(own)) == len(set(h))
    wins = wordhash.window_hashes(wordhash.word_hashes(buf, starts, ends), 3).tolist()
    keys = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    assert len(set(zip(keys, wins, strict=True))) == len(set(keys)) == len(set(wins))


def test_word_hashes_across_chunks(monkeypatch):
    monkeypatch.setattr(wordhash, "_CHUNK", 64)
    wordhash._powers.clear()
    raw = b" ".join([b"ab", b"c" * 300, b"ab", b"d" * 70, b"e"] * 40 + [b"c" * 300])
    buf = np.frombuffer(raw, np.uint8)
    h = wordhash.word_hashes(buf, *wordhash.word_bounds(buf)).tolist()
    assert len(set(h)) == 4 and h[0] == h[5] and h[1] == h[-1]
    wordhash._powers.clear()


def test_fingerprint_by_hand():
    assert simhash_dedup.fingerprint(None) == simhash_dedup.fingerprint(" \n") == 0
    assert simhash_dedup.fingerprint("Ab cD") == xxhash.xxh64_intdigest(b"ab cd", 42)
    h = [xxhash.xxh64_intdigest(b"a b c", 42), xxhash.xxh64_intdigest(b"b c d", 42)]
    assert simhash_dedup.fingerprint("A b\tc  d") == h[0] & h[1]
    assert simhash_dedup.fingerprint("É b") == xxhash.xxh64_intdigest("É b".encode(), 42)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_chain_links_lose_no_pair(spark, radius):
    r = random.Random(radius)
    fps = set()
    for _ in range(25):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(8):
            x = base
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    own = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    got = {(x["a"], x["b"]) for x in simhash_dedup.chain_links(spark.createDataFrame([(x,) for x in own], "fp long"), radius).distinct().collect()}
    assert got == want and (want or radius == 0)


def test_chains_are_not_broadcast(spark):
    links = simhash_dedup.chain_links(spark.createDataFrame([(x,) for x in range(40)], "fp long"))
    assert links.distinct().count() == sum(bin(a ^ b).count("1") <= 2 for a in range(40) for b in range(a))
    links.collect()  # what ran, not what was planned at first
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_and_filter(spark):
    docs = corpus(4)
    fps = [(i, simhash_dedup.fingerprint(t)) for i, t in docs]
    comp = list(range(len(fps)))
    adj = [[j for j, (_, b) in enumerate(fps) if bin(a ^ b).count("1") <= 2] for _, a in fps]
    while True:
        new = [min(comp[k] for k in adj[j]) for j in range(len(fps))]
        if new == comp:
            break
        comp = new
    least = defaultdict(list)
    for (i, _), c in zip(fps, comp, strict=True):
        least[c].append(i)
    want = sorted(((i, f, min((x for x in least[c] if x is not None), default=None)) for (i, f), c in zip(fps, comp, strict=True)), key=str)
    df = frame(spark, docs).withColumnsRenamed({"block": "gone_id", "owner": "__id", "n": "gone", "pass": "word_0"})
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == want
    kept = simhash_dedup.distinct_documents(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == expected_kept(docs, want)


def grouped(fps, radius):
    """id -> a name of its component over links within the radius of any of its fingerprints."""
    label = {i: n for n, i in enumerate(fps)}
    while True:
        new = {i: min(label[j] for j in fps if any(bin(x ^ y).count("1") <= radius for x in fps[i] for y in fps[j])) for i in fps}
        if new == label:
            return label
        label = new


def expected_kept(docs, want):
    """Brute force of the filter: components, then for each word fingerprint keep-first in order of ids within its groups."""
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t)
    left = sorted({i for i, _, c in want if i is not None and i == c})
    for seed in simhash_dedup.WORD_SEEDS:
        label = grouped({i: {simhash_dedup.word_fingerprint(t, seed) for t in texts[i]} for i in left}, simhash_dedup.WORD_RADIUS)
        stay = []
        for i in left:
            if not any(label[i] == label[j] and any(simhash_dedup.shingle_similarity(t, min(x or "" for x in texts[j])) >= 0.8 for t in texts[i]) for j in stay):
                stay.append(i)
        left = stay
    return set(left) | ({None} & set(texts))


def test_filter_takes_light_edits_and_leaves_others(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7)))
    docs, edited = [], []
    for k in range(20):
        base = [word() for _ in range(400)]
        docs.append((k, " ".join(base)))
        for e in range(3):
            copy = list(base)
            for _ in range(e + 1):
                copy[r.randrange(400)] = word()
            edited.append((100 + 10 * k + e, " ".join(copy)))
    kept = {x["doc_id"] for x in simhash_dedup.distinct_documents(frame(spark, docs + edited)).collect()}
    assert kept >= {i for i, _ in docs}
    assert len(kept) <= 20 + 0.2 * len(edited)
    assert simhash_dedup.shingle_similarity("a b c d e f", "a b c d e g") == pytest.approx(1 / 3)
    assert simhash_dedup.shingle_similarity(None, " ") == 1.0 and simhash_dedup.shingle_similarity("a", None) == 0.0


def versions(seed, chains, length, size=500):
    """Chains of versions of a text, two neighbouring words replaced from each to the next; ids are dealt at random."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7)))
    out = []
    for _ in range(chains):
        text = [word() for _ in range(size)]
        for _ in range(length):
            at = r.randrange(size - 1)
            text[at : at + 2] = word(), word()
            out.append(" ".join(text))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("head", [3, 256])
def test_filter_holds_members_against_all_that_stay(spark, monkeypatch, head):
    monkeypatch.setattr(simhash_dedup, "HEAD", head)
    docs = versions(3, 6, 40)
    kept = {x["doc_id"] for x in simhash_dedup.distinct_documents(frame(spark, docs)).collect()}
    first = grouped({i: {simhash_dedup.fingerprint(t)} for i, t in docs}, 2)
    least = {c: min(i for i in first if first[i] == c) for c in first.values()}
    want = expected_kept(docs, [(i, None, least[c]) for i, c in first.items()])
    assert kept == want
    assert len(kept) < len(least)


@pytest.mark.parametrize(("n", "most"), [(300, 2), (1500, 3)])
def test_rounds_grow_slowly_with_a_group(spark, monkeypatch, n, most):
    """The same words in other orders: equal word fingerprints, nothing similar."""
    rounds, settle = [], simhash_dedup._settle
    monkeypatch.setattr(simhash_dedup, "_settle", lambda *a: (rounds.append(a[-1]), settle(*a))[1])
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.sample(words, 60))) for i in range(n)] + [(n, "z " * 30)]
    kept = simhash_dedup.distinct_documents(frame(spark, docs), seeds=(42,))
    assert kept.count() == n + 1 and len(rounds) <= most


def test_member_texts_are_not_broadcast(spark, tmp_path):
    frame(spark, [(i, "the same words again " * 5) for i in range(6)]).write.parquet(f"{tmp_path}/members")
    members = spark.createDataFrame([(i, 0) for i in range(6)], "doc_id long, centre long")
    settled = simhash_dedup._settle(spark.read.parquet(f"{tmp_path}/members").select("doc_id", "text"), members, 0.8, 5, 2)
    nodes = [settled._jdf.queryExecution().executedPlan().initialPlan()]
    for node in nodes:
        assert not (node.nodeName().startswith("Broadcast") and "text#" in node.output().mkString(","))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert {(r["doc_id"], r["gone"]) for r in settled.collect()} == {(0, False), *((i, True) for i in range(1, 6))}


def test_recall_of_similar_pairs(spark):
    """Copies of long and short texts with as many words replaced as keep five-word shingles similar by 0.8: of such pairs 0.9 lose a member."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    texts = []
    for _ in range(120):
        size = r.choice([60, 120, 300, 900])
        base = [word() for _ in range(size)]
        texts.append(base)
        copy = list(base)
        for _ in range(r.randint(1, max(1, size // 46))):
            copy[r.randrange(size)] = word()
        texts.append(copy)
    docs = list(enumerate(" ".join(t) for t in texts))
    kept = {x["doc_id"] for x in simhash_dedup.distinct_documents(frame(spark, docs)).collect()}
    similar = [k for k in range(0, 240, 2) if simhash_dedup.shingle_similarity(docs[k][1], docs[k + 1][1]) >= 0.8]
    assert len(similar) > 100 and {k for k in range(0, 240, 2)} <= kept
    assert sum(k + 1 not in kept for k in similar) >= 0.9 * len(similar)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.frozensets(st.sampled_from([bytes([x]) for x in range(12)]), max_size=12), max_size=12), st.sampled_from([0.5, 0.6, 0.8, 1.0]))
def test_kept_sets_are_found_again(sets, similar):
    kept, plain = simhash_dedup._Kept(similar), []
    for own in (np.array(sorted(b[0] for b in x), np.uint64) for x in sets):
        assert kept.like(own) == any(simhash_dedup._jaccard(own, x) >= similar for x in plain)
        kept.add(own)
        plain.append(own)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), max_size=25))
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 301


@pytest.mark.parametrize("bound", [True, False])
def test_decontamination_equals_brute_force(spark, monkeypatch, bound):
    if not bound:  # every window is fingerprinted: what is found comes from the index alone
        monkeypatch.setattr(decontaminate.Benchmark, "hits", lambda self, width, grams: np.arange(len(grams)))
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((14, 20, 33, 50, 6, 5))] + [(50, "Only Three words"), (51, None), (52, ""), (53, "aa bb aa bb aa bb aa bb aa bb")]
    docs = []
    for i in range(80):
        item = list(r.choice(items[:6])[1].split())
        for _ in range(r.randrange(3)):
            item[r.randrange(len(item))] = word()
        if r.random() < 0.2:
            item = item[: int(len(item) * 0.9)]
        inside = [x.upper() + "," if r.random() < 0.1 else x for x in item]
        around = [word() for _ in range(r.choice([0, 0, 30]))]
        docs.append((i, " ".join(around + inside + around)))
    docs += [(100, None), (101, ""), (102, "x only THREE words. y only three words"), (103, "z aa bb aa bb aa bb aa bb aa bb q"), (None, items[0][1]), (7, items[1][1])]

    def tokens(t):
        return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (t or "").lower()).split()

    def bag(w):
        k = min(5, len(w))
        return Counter(tuple(w[p : p + k]) for p in range(len(w) - k + 1))

    def best(w, q):
        if not q or not w or min(len(q), 5) > len(w):
            return 0.0
        n, b, found = min(len(q), len(w)), bag(q), 0.0
        for p in range(len(w) - n + 1):
            a = bag(w[p : p + n])
            both = sum((a & b).values())
            found = max(found, both / (sum(a.values()) + sum(b.values()) - both))
        return found

    want = Counter()
    for i, t in docs:
        for k, text in items:
            similarity = best(tokens(t), tokens(text))
            if similarity >= 0.8:
                want[i, k, round(similarity, 9)] += 1
    df = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((x["doc_id"], x["item_id"], round(x["similarity"], 9)) for x in decontaminate.contaminated(df, bench).collect())
    assert got == want and len(want) > 20
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns
    hit = {(i, t) for i, t in docs if any(best(tokens(t), tokens(q)) >= 0.8 for _, q in items)}
    assert Counter((x["doc_id"], x["text"]) for x in clean.collect()) == Counter((i, t) for i, t in docs if (i, t) not in hit)


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(9)], "item_id long, text string")
    docs = frame(spark, [(k, "before " + " ".join(f"w{k}x{j}" for j in range(20))) for k in range(12)])
    whole = sorted(decontaminate.contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", 300)
    assert sorted(decontaminate.contaminated(docs, items).collect()) == whole and len(whole) == 9
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(docs, items).collect()) == [9, 10, 11]


def test_multi_index_finds_all_within_radius_and_prunes():
    r = np.random.default_rng(3)
    prints = r.integers(0, 1 << 64, (300, decontaminate.BLOCKS), dtype=np.uint64)
    index = decontaminate.MultiIndex(prints)
    own = []
    for _ in range(50):
        bits = np.unpackbits(prints[r.integers(300)].view(np.uint8))
        bits[r.choice(decontaminate.BITS, r.integers(0, 160), replace=False)] ^= 1
        own.append(np.packbits(bits).view(np.uint64))
    own = np.stack(own)
    far = np.bitwise_count(own[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    q, i = index.near(own)
    assert set(zip(q.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS)))) and len(q) > 20
    q, _ = index.passing(r.integers(0, 1 << 64, (300, decontaminate.BLOCKS), dtype=np.uint64))
    assert len(q) < 0.01 * 300 * 300


def test_window_prints_by_hand(monkeypatch):
    r = np.random.default_rng(1)
    grams = r.integers(0, 1 << 64, 400, dtype=np.uint64)
    starts = np.array([0, 1, 2, 30, 31, 200, 390])
    monkeypatch.setattr(decontaminate, "_RUN", 25)
    got = decontaminate.window_prints(grams, starts, 10)
    for s, fp in zip(starts.tolist(), got, strict=True):
        assert (decontaminate.window_prints(grams[s : s + 10], np.zeros(1, np.int64), 10)[0] == fp).all()
    one = decontaminate.window_prints(grams, np.array([7]), 1)[0]
    assert one[0] == wordhash.mix(grams[7:8] + np.uint64(0x9E3779B97F4A7C15))[0]


def test_radius_holds_similar_windows():
    """Windows whose weighted similarity is just 0.8 or above stay within the radius."""
    r = np.random.default_rng(4)
    for m in (9, 10, 14, 20, 46, 100):
        common = decontaminate.least_common(m, m)
        for _ in range(300):
            a = r.integers(0, 1 << 64, m, dtype=np.uint64)
            b = np.concatenate([a[:common], r.integers(0, 1 << 64, m - common, dtype=np.uint64)])
            x, y = (decontaminate.window_prints(v, np.zeros(1, np.int64), m)[0] for v in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= decontaminate.RADIUS


def test_forward_sums_all_segmentations():
    m = langid.Model(["x"], ["a", "b", "ab", " a", " "], np.array([[0.2], [0.1], [0.3], [0.25], [0.05]]))
    # " ab": " |a|b", " a|b", " |ab"
    want = 0.05 * 0.2 * 0.1 + 0.25 * 0.1 + 0.05 * 0.3
    assert np.exp(m.log_probs(["ab", "ab"])) == pytest.approx(np.array([[want], [want]]))
    got = np.zeros_like(m.table)
    m.expect(["ab"], np.array([[2.0]]), got)
    assert got[2, 0] == pytest.approx(2 * 0.05 * 0.3 / want)
    assert np.isfinite(m.log_probs(["z" * 500, "a" * 100_000])).all()


def test_long_words_are_segmented_whole(monkeypatch):
    r = random.Random(3)
    pieces = ["a", "b", "c", "ab", "bca", " a", " ", "abcab", "cc", "aaaaaaaaaaaaaaaaaab"]
    probs = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    m = langid.Model(["x", "y"], pieces, probs)
    words = ["".join(r.choice("abcd") for _ in range(r.choice([1, 5, 39, 40, 41, 60, 90, 300]))) for _ in range(40)] + ["a" * 80, "b" * 41]

    def plain(word, k):  # logs of the sums over all segmentations, by whole numbers of Python
        from fractions import Fraction

        table = dict(zip(pieces, map(Fraction, probs[:, k].tolist()), strict=True))
        word, sums = " " + word, [Fraction(1)]
        for j in range(1, len(word) + 1):
            total = Fraction(0)
            for i in range(max(0, j - 19), j):
                p = table.get(word[i:j], Fraction(langid.FLOOR) if j - i == 1 else 0)
                total += sums[i] * p
            sums.append(total)
        import math

        return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)

    got = m.log_probs(words)
    assert got == pytest.approx(np.array([[plain(w, 0), plain(w, 1)] for w in words]))
    weights = np.ones((len(words), 2))
    own, all_long = np.zeros_like(m.table), np.zeros_like(m.table)
    m.expect(words, weights, own)
    monkeypatch.setattr(langid, "SHORT", 0)
    assert m.log_probs(words) == pytest.approx(got)
    m.expect(words, weights, all_long)
    assert all_long == pytest.approx(own)


def test_language_id(spark, monkeypatch):
    import public_tokenizers

    r = random.Random(1)
    pools = {"en": "the of and with that was for into they have this from which".split(), "de": "der die und mit nicht ein auch sich werden haben durch über".split()}
    rows = [(i, " ".join(r.choice(pools[lang]) for _ in range(25)), lang) for i in range(60) for lang in [r.choice(["en", "de"])]]
    rows += [(100, None, "en"), (101, "", None), (102, "123 ... !!", "de"), (103, "ß", None), (None, "und die", None), (104, "the " * 3000, None), (5, "doppelt und", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where(~langid.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    assert model.langs == ["de", "en"] and model.probs.sum(axis=0) == pytest.approx([1, 1])
    out = langid.predict(df.withColumn("score_", F.lit(1)), model).collect()
    assert len(out) == len(rows)
    for x in out:
        if x["doc_id"] in (100, 101, 102):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
        elif x["lang"]:
            assert x["lang_pred"] == x["lang"] and 0.5 < x["score"] <= 1
    assert {x["lang_pred"] for x in langid.predict(df, langid.fit(df.where("false"), public_tokenizers.path("piece_bpe_32k.model"))).collect()} == {"und"}
    clash = df.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    again = langid.predict(clash, model)
    assert again.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and sorted(map(str, again.collect())) == sorted(map(str, langid.predict(df, model).collect()))
    kept = langid.keep_known(clash, model, 0.5)
    assert kept.columns == clash.columns
    sure = Counter((x["doc_id"], x["text"]) for x in again.where("lang_pred <> 'und' and score >= 0.5").collect())
    assert Counter((x["doc_id"], x["text"]) for x in kept.collect()) == sure and sum(sure.values()) == len(rows) - 3
    assert langid.predict(df.where("false"), model).count() == langid.keep_known(df.where("false"), model, 0.5).count() == 0
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    with pytest.raises(ValueError, match="labels"):
        langid.fit(df, public_tokenizers.path("piece_bpe_32k.model"))
    import zlib

    held = {x["doc_id"]: x["h"] for x in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items() if i is not None) and held[None] is False


def test_accuracy_on_held_out_documents(spark):
    """The registered query on the driver's tables: documents held out of fitting are named right."""
    import os

    from lexiloom.llm import queries

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(f"{folder}/documents.parquet"):
        pytest.skip("no driver tables here")
    out = queries.op3_language_id(spark, folder)
    told = out.where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(told) > 100 and sum(x["lang"] == x["lang_pred"] for x in told) >= 0.97 * len(told)
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_hash_of_kept_words_matches_spark(spark):
    got = substring_dedup.remove_repeats(spark.createDataFrame([(1, "a  b")], "doc_id long, text string")).select(F.sha2("kept", 256).alias("h")).first()["h"]
    assert got == hashlib.sha256(b"a b").hexdigest()
