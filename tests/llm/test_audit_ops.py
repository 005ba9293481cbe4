"""Exact dedup, source divergence and token alignment against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import divergence, exact_dedup, queries, token_align

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = "doc_id long, text string, lang string, source string, full string, hit int, n long, p double, keep int, row int, slot int, bitmap int"


# --- exact dedup ---------------------------------------------------------------


def groups_by_force(rows):
    same = defaultdict(list)
    for i, t in rows:
        same[t or ""].append(i)
    key = lambda i: -(1 << 62) if i is None else i
    return [(i, max(same[t or ""], key=key), len(same[t or ""])) for i, t in rows]


def order(rows):
    return sorted(rows, key=str)


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, 2, 0.5, 3, 4, 5, 6) for i, t in rows], CLASH).repartition(parts)


def many_texts(seed=3):
    r = random.Random(seed)
    head = "h" * exact_dedup.PREFIX
    texts = ["", "a", "A", "a ", "é", "é", "\x00", head + "x", head + "y", head, "long " * 300_000, "long " * 299_999 + "gnol "]
    rows = [(i, r.choice([None, *texts])) for i in range(400)]
    return rows + [(400 + i, "hot") for i in range(300)] + [(1000 + i, f"only {i}") for i in range(50)]


@pytest.mark.parametrize("most_bits", [exact_dedup.MOST_BITS, 0])
def test_equal_texts_match_brute_force(spark, most_bits):
    rows = many_texts()
    got = exact_dedup.equal_texts(documents(spark, rows), most_bits=most_bits).collect()
    assert order((r.doc_id, r.keep_id, r.group_size) for r in got) == order(groups_by_force(rows))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_equal_texts_with_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "d"), (None, None), (3, "")]
    got = exact_dedup.equal_texts(documents(spark, rows)).collect()
    assert order((r.doc_id, r.keep_id, r.group_size) for r in got) == order(groups_by_force(rows))
    assert order((r.doc_id, r.group_size) for r in got if r.kept) == order([(1, 3), (None, 2), (7, 1), (7, 1), (3, 2)])


def test_equal_texts_of_an_empty_table(spark):
    got = exact_dedup.equal_texts(documents(spark, []))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept"] and got.count() == 0


def test_only_surviving_rows_have_their_text_read(spark):
    """A text whose length or prefix no other has gets no full hash: its bit is set by chance alone."""
    rows = documents(spark, [(i, "x" * i) for i in range(200)] + [(900, "y" * 30)])
    shape = rows.select(exact_dedup.F.octet_length("text").alias("n"))
    bitmap, bits = exact_dedup.shared_keys(shape, exact_dedup.F.xxhash64("n"))
    hits = exact_dedup.with_hits(shape, exact_dedup.F.xxhash64("n"), bitmap, bits).where("hit").collect()
    assert Counter(r.n for r in hits)[30] == 2 and len(hits) < 10


def test_bitmap_size_is_bounded():
    assert exact_dedup._bits_for(0, exact_dedup.MOST_BITS) == exact_dedup.ROW_BITS
    assert exact_dedup._bits_for(10**6, exact_dedup.MOST_BITS) == 1 << 23
    assert exact_dedup._bits_for(10**12, exact_dedup.MOST_BITS) == exact_dedup.MOST_BITS


def test_distinct_texts_keep_every_column(spark):
    got = exact_dedup.distinct_texts(documents(spark, [(1, "a"), (2, "a"), (None, "b"), (4, None), (5, "")]))
    assert got.columns == [c.split()[0] for c in CLASH.split(", ")]
    assert order((r.doc_id, r.text) for r in got.collect()) == order([(2, "a"), (None, "b"), (5, "")])


def test_exact_dedup_plan_is_native(spark):
    plan = queries.op11_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan and "ExistingRDD" not in plan


# --- source divergence -----------------------------------------------------------


def divergence_by_force(rows, least=3, top=200):
    docs = [(i, *(x or "" for x in r)) for i, r in enumerate(rows)]
    low = str.maketrans(divergence.UPPER, divergence.LOWER)
    terms = {i: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low)) for i, text, _, _ in docs}
    found, of = defaultdict(set), defaultdict(Counter)
    for i, _, lang, source in docs:
        of[lang, source].update(terms[i])
        for t in terms[i]:
            found[lang, t].add(i)
    out = []
    for lang in {g[0] for g in of}:
        kept = sorted(t for k, t in found if k == lang and len(found[k, t]) >= least)
        count = {s: Counter({t: c[t] for t in kept}) for (k, s), c in of.items() if k == lang}
        count[None] = sum(count.values(), Counter())
        share = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        value = lambda p, q: (p - q) ** 2 // q
        for s in count.keys() - {None}:
            pairs = [(-sum(value(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in count.keys() - {None, s}]
            mine = [(-value(share[s][t], share[None][t]), t.encode(), t) for t in kept if count[s][t] and share[s][t] > share[None][t]]
            out += [(lang, s, "pair", o, -v, n) for n, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, n) for n, (v, _, t) in enumerate(sorted(mine)[:top], 1)]
    return out


def term_rows(n=300, seed=5):
    r = random.Random(seed)
    words = ["the", "The", "über", "Über", "ÜBER", "é", "e", "x-y", "a1b", "日本", "\x00z", "it's", "Ω", "w"]
    return [(r.choice([None, "", " ".join(r.choices(words, k=r.randint(1, 30)))]), r.choice(["en", "en", "de", None, ""]), r.choice(["s1", "s2", "S1", "", None, "ü"])) for _ in range(n)]


@pytest.mark.parametrize("most", [divergence.MOST_GROUPS, 0])
def test_divergence_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(divergence, "MOST_GROUPS", most)
    rows = [*term_rows(), ("lone text", "fr", "only"), (None, "es", "a"), ("...", "es", "b"), ("word " * 200_000, "de", "s2")]
    df = spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], "text string, lang string, source string, p int, tid int, item string, term string, gid int").repartition(5)
    got = divergence.divergence(df, top=4)
    assert order(map(tuple, got.collect())) == order(divergence_by_force(rows, top=4))


def test_divergence_of_an_empty_table(spark):
    got = divergence.divergence(spark.createDataFrame([], "text string, lang string, source string"))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0


def test_shares_are_exact_beyond_a_long(spark):
    got = spark.range(1).selectExpr("9000000000000 as c", "9007199254740993 as n", "12345 as v").select(divergence.share("c", "n", "v")).first()[0]
    assert got == 1 + 10**9 * 9000000000001 // (9007199254740993 + 12345)


# --- token alignment ---------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


TEXTS = [
    None, "", " ", "   ", "\n", "a", "Größe it's 123", " lead and trail ", "double  space   three", "日本語 テキスト 😀👍🏽", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ marks ▁▁", "tab\tnew\r\nline", "nul\x00in", "é ﬁ Å",
    "a" * 3000, "word " * 4000, "same", "same", "internationalization unbelievable", "x " * 9 + "  ", " nbsp　wide",
]


def encoded(libraries, text):
    """Ids with their byte ranges by both, or None where the bytes are not the text's."""
    a, b = libraries
    if not text:
        return None
    tokens = token_align.byte_level_tokens(A), token_align.piece_tokens(B)
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if any(b"".join(t[i] for i in x) != (" " + text).encode() for t, x in zip(tokens, ids, strict=True)):
        return None
    out = []
    for t, x in zip(tokens, ids, strict=True):
        at, own = 0, []
        for i in x:
            own.append((i, at, at + len(t[i])))
            at += len(t[i])
        out.append(own)
    return out


def summary_by_force(libraries, rows):
    links, docs = Counter(), []
    for i, text in rows:
        got = encoded(libraries, text) or ([], [])
        ends_b = {end: k for k, (_, _, end) in enumerate(got[1])}
        mine = [(a, got[1][ends_b[end]][0]) for a, _, end in got[0] if end in ends_b]
        cuts = sorted({e for _, _, e in got[0]} & ends_b.keys())
        groups = ["|".join(",".join(str(x) for x, _, e in side if lo < e <= hi) for side in got) for lo, hi in zip([0, *cuts], cuts)]
        links.update(mine)
        docs.append((i, len(got[0]), len(got[1]), len(cuts), mine, hashlib.sha256(";".join(groups).encode()).hexdigest() if cuts else ""))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [(i, na, nb, g, len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), sha) for i, na, nb, g, own, sha in docs]


def test_summaries_match_brute_force(spark, libraries):
    r = random.Random(9)
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(r.choices("ab éß日 \n\t.12😀", k=r.randint(1, 60)))) for i in range(60)] + [(None, "no id"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = token_align.summarize(df, A, B).collect()
    assert order(map(tuple, got)) == order(summary_by_force(libraries, rows))
    assert any(x.n_a == 0 and x.doc_id == TEXTS.index("▁ marks ▁▁") for x in got)


def test_query_on_the_smallest_tables(spark, libraries):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = queries.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()
    assert order(map(tuple, got)) == order(summary_by_force(libraries, [tuple(x) for x in df.collect()]))


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.summarize(df, A, B).count() == 0 and token_align.overlaps(df, A, B).count() == 0


@pytest.fixture(scope="module")
def aligner():
    return token_align.Aligner(A, B)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab cé▁\n\t😀日's1<0xA>"), max_size=30), max_size=5))
def test_pieces_of_words_are_those_of_whole_texts(aligner, libraries, texts):
    got = aligner.encoders[1].encode_batch([" " + t if t else None for t in texts])
    for t, ids in zip(texts, got, strict=True):
        if "▁" not in t:  # such texts are left out
            assert ids.tolist() == (libraries[1].encode(t) if t else [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_overlaps_cover_both_token_rows(aligner, libraries, texts):
    got = aligner.align(texts)
    want = [encoded(libraries, t) or ([], []) for t in texts]
    pairs = []
    base_a = base_b = 0
    for a, b in want:
        pairs += [(base_a + i, base_b + j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        base_a, base_b = base_a + len(a), base_b + len(b)
    assert list(zip(got.over_a.tolist(), got.over_b.tolist(), strict=True)) == pairs
    assert got.n_a.tolist() == [len(a) for a, _ in want]


def test_overlap_rows(spark, libraries):
    rows = [(1, "Größe  it's"), (2, None), (3, "internationalization unbelievable ok"), (None, "x")]
    got = token_align.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    want = []
    for i, text in rows:
        x, y = encoded(libraries, text) or ([], [])
        want += [(i, k, m, a, b, max(a0, b0), min(a1, b1), a1 == b1) for k, (a, a0, a1) in enumerate(x) for m, (b, b0, b1) in enumerate(y) if a0 < b1 and b0 < a1]
    assert order(map(tuple, got)) == order(want)


def test_every_link_is_possible(libraries):
    a, b = token_align.byte_level_tokens(A), token_align.piece_tokens(B)
    bound = token_align.possible_links(a, b)
    assert 10_000 < bound < token_align.MOST_PAIRS
    assert token_align.possible_links([b"ab", b"b"], [b"b", b"xab", b"c"]) == 4
    assert np.unique([len(x) for x in a]).min() > 0


def test_too_many_pairs_are_refused(spark, monkeypatch):
    monkeypatch.setattr(token_align, "MOST_PAIRS", 10)
    with pytest.raises(ValueError, match="can link"):
        token_align.summarize(spark.createDataFrame([(1, "a")], "doc_id long, text string"), A, B)
