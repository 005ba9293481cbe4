"""Tokenizer, archive, store, embedding and URL operators against brute force and round trips; the pipeline as a whole."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import bpe, embed_dedup, pretokens, storage, token_store, url_filter, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "very long \u00e9 text " * 400_000
TEXTS = [None, "", " ", "\n\n  \t x", "<|endoftext|> it's Größe 123\u0085\u2028 \x1c\x00a", "日本語 テキスト 😀👍🏽", "word " * 4000, "a" * 3000, "same", "same", "don't\r\n won't'S"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pretokens_match_both_libraries(tiktoken_encoding, library, text):
    single = tiktoken_encoding._core_bpe.encode_single_piece
    found = pretokens.splitter()(text)
    assert "".join(found) == text
    assert all(pretokens.splitter()(w) == [w] for w in found)
    assert [i for w in found for i in single(w.encode())] == tiktoken_encoding.encode_ordinary(text)
    assert token_store_encoder().encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


PIECES = st.sampled_from(["'", "'s", "'re", "'ll", "'ve", "l", "S", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "\x85", "a", "é", "1", "²", "½", "٣", "!", "_", "日", "😀", "\u0301", "\u200d", "x'd", "\ufeff"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), max_size=4))
def test_split_points_match_the_pattern(texts):
    codes, bases = pretokens.code_points(texts)
    begins, ends = pretokens.split_points(codes)
    got = [[] for _ in texts]
    for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
        t = int(np.searchsorted(bases, i, side="right")) - 1
        got[t].append(texts[t][i - bases[t] : j - bases[t]])
    assert got == [pretokens.splitter()(t) for t in texts]


def test_word_table():
    r = np.random.default_rng(1)
    table = pretokens.WordTable(bits=8)
    a = r.integers(0, 1 << 60, 150).astype(np.uint64) & np.uint64((1 << 57) - 1)  # crowded slots
    b = r.integers(0, 1 << 60, 150).astype(np.uint64)
    a[1] = a[0]  # told apart by the second hash
    assert (table.find(a, b) == -1).all()
    rows = np.concatenate([table.add(a[:70], b[:70]), table.add(a[70:], b[70:])])
    assert (table.find(a, b) == rows).all() and (np.sort(rows) == np.arange(150)).all()
    assert table.find(a, b + np.uint64(1)).max() == -1


def token_store_encoder():
    return token_store._encoder(JSON)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5, "w", b"i", 1) for i, t in rows], "doc_id long, text string, block long, words string, ids binary, owner int").repartition(3)


@pytest.mark.parametrize("block", [50, 1 << 22])
def test_bpe_round_trip(spark, tiktoken_encoding, block, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 40)
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id")]
    want = Counter((i, np.array(tiktoken_encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    once = bpe.encode(table(spark, rows), RANKS, block_bytes=block, decoded=True).collect()
    apart = bpe.decode(bpe.encode(table(spark, rows), RANKS, block_bytes=block), RANKS).collect()
    assert all(Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want for got in (once, apart))
    assert bpe.encode(table(spark, []), RANKS).count() == 0


@pytest.mark.parametrize(("fan", "range_bytes", "blob_words", "buckets"), [(3, 2000, 1, 5), (2, 500, 4, 100_000), (4096, 10_000, 32, 3)])
def test_bpe_with_two_levels_and_few_buckets(spark, monkeypatch, tiktoken_encoding, fan, range_bytes, blob_words, buckets):
    """As with very large inputs: fewer coarse ranges than wanted, teams of blocks, several ranges and blocks in a bucket."""
    for name, value in (("FAN", fan), ("RANGE_BYTES", range_bytes), ("BLOB_WORDS", blob_words), ("BLOCK_WORDS", 8), ("MOST_BUCKETS", buckets)):
        monkeypatch.setattr(bpe, name, value)
    r = random.Random(4)
    rows = [*enumerate(TEXTS), *[(100 + i, " ".join(r.choices(["common", "Größe", "x", f"w{i}", "it's", "日本"], k=r.randint(0, 40)))) for i in range(150)], (None, "no id")]
    if fan < 4096:
        ranges = bpe._ranges_for(spark, 30_000, 300)
        assert ranges.sub > 1 and ranges.teams > 1
    got = bpe.encode(table(spark, rows), RANKS, block_bytes=300, decoded=True).collect()
    want = [(i, np.array(tiktoken_encoding.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows]
    assert sorted(((x.doc_id, bytes(x.ids), bytes(x.decoded)) for x in got), key=str) == sorted(want, key=str)


def test_ranges_of_a_hundred_terabytes_stay_bounded(spark):
    ranges = bpe._ranges_for(spark, 100 << 40, bpe.BLOCK_BYTES)
    assert ranges.coarse == bpe.FAN and ranges.coarse * ranges.sub * bpe.RANGE_BYTES >= 100 << 40
    blocks = (100 << 40) // bpe.BLOCK_BYTES
    assert blocks / ranges.teams * bpe.BLOCK_WORDS / bpe.FAN / ranges.sub >= 0.9 * bpe.BLOB_WORDS


def test_decoding_of_nothing_and_of_unknown_ids(spark):
    frame = lambda x: spark.createDataFrame([(1, x)], "doc_id long, ids binary")
    assert bpe.decode(frame(None), RANKS).first()["decoded"] is None and bytes(bpe.decode(frame(b""), RANKS).first()["decoded"]) == b""
    with pytest.raises(Exception, match="not in the token table"):
        bpe.decode(frame(b"\xff\xff\xff\x7f"), RANKS).collect()


def test_token_store(spark, library):
    rows = [*enumerate(TEXTS), (50, TEXTS[6]), (3, TEXTS[3])]
    path = token_store.write_store(table(spark, rows), storage.new_path(spark, "t"), JSON, segment=4)
    ids = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows), key=lambda x: x[0])
    want, start = [], 0
    for i, own in ids:
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, token_store.read_index(spark, path).collect())) == sorted(want)
    back = sorted((r["doc_id"], r["start"], r["ids"]) for r in token_store.read_documents(spark, path).collect())
    assert [(i, x) for i, _, x in back] == ids
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    used = sum(r["n"] for r in spark.read.parquet(f"{path}/recipes").selectExpr("size(chunks) n").collect())
    assert chunks.count() < used  # equal texts share theirs
    empty = token_store.write_store(table(spark, []), storage.new_path(spark, "t"), JSON)
    assert token_store.read_index(spark, empty).count() == 0


def test_token_store_notices_damage(spark):
    from pyspark.sql import functions as F

    path = token_store.write_store(table(spark, [(1, "some text"), (2, "other")]), storage.new_path(spark, "t"), JSON)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    bad = [(r["digest"], r["n_ids"], bytes(r["ids"])[:-1] + bytes([bytes(r["ids"])[-1] ^ 1])) for r in chunks]
    spark.createDataFrame(bad, "digest binary, n_ids int, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="does not fit its digest"):
        token_store.read_index(spark, path).collect()
    again = token_store.write_store(table(spark, [(1, "some text"), (2, "other")]), storage.new_path(spark, "t"), JSON)
    changed = spark.read.parquet(f"{again}/recipes").withColumn("chunks", F.reverse(F.array_union("chunks", F.array(F.lit(b"x")))))
    spark.createDataFrame(changed.collect(), changed.schema).write.mode("overwrite").parquet(f"{again}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_index(spark, again)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50_000), max_size=9000), st.binary(max_size=50), st.binary(max_size=50))
def test_cuts_and_crcs(ids, a, b):
    x = np.array(ids, dtype=np.uint32)
    ends = token_store.cut(x)
    assert (ends[-1] if ends else 0) == len(x) and all(0 < q - p <= token_store.GREATEST for p, q in zip([0, *ends], ends, strict=False))
    shifted = token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))
    assert int(shifted[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_token_store_of_special_tokens(spark, library):
    texts = ["hello <|endoftext|> x", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|", "x <|endoftext|><|endoftext|>\n"]
    path = token_store.write_store(table(spark, list(enumerate(texts))), storage.new_path(spark, "t"), JSON)
    got = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, path).collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert got[0] == [31373, 220, 50256, 2124, 2]


def test_a_very_long_text(spark, tiktoken_encoding, library):
    got = bpe.decode(bpe.encode(table(spark, [(1, LONG), (2, "x")]), RANKS), RANKS).collect()
    assert {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in got} == {1: (np.array(tiktoken_encoding.encode_ordinary(LONG), "<u4").tobytes(), LONG.encode()), 2: (np.array(tiktoken_encoding.encode_ordinary("x"), "<u4").tobytes(), b"x")}
    path = token_store.write_store(table(spark, [(1, LONG)]), storage.new_path(spark, "t"), JSON)
    assert token_store.read_index(spark, path).first()["ids_crc32"] == zlib.crc32(np.array([*library.encode(LONG, add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_cuts_are_content_defined():
    r = np.random.default_rng(1)
    x = r.integers(0, 50_000, 20_000).astype(np.uint32)
    pieces = lambda v: {v[p:q].tobytes() for p, q in zip([0, *token_store.cut(v)], token_store.cut(v), strict=False)}
    moved = np.concatenate([r.integers(0, 50_000, 37).astype(np.uint32), x])
    assert len(pieces(x) & pieces(moved)) > 0.8 * len(pieces(x))


def test_warc_round_trip_with_magic_in_payloads(spark):
    full = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 70\r\n\r\nHTTP/1.1 200 OK\r\n\r\n{'x' * 49}\r\n\r\n"
    rows = [(1, "http://a", "x" * 1500), (2, "http://b\r\nq", "x" * 1500), (3, None, None), (4, "u", "pre" + full + "post"), (5, "u", full * 30), (6, "u", full * 30), (None, "u", "y" * 1200), (None, "v", "y" * 1200), (7, "u", "WARC/1.0\r\n"), (8, "é", "é" * 600), (8, "z", "é" * 600), (9, "u", "a\r\n\r\nb"), (10, "u", "x" * 999), (11, "u", "x" * 999)]
    rows += [(100 + i, "u", ("WARC/1.0\r\n" + str(i)) * (i % 300)) for i in range(40)]
    df = spark.createDataFrame([(i, u, h, 1, 2, "p") for i, u, h in rows], "page_id long, url string, html string, block long, at int, piece string").repartition(3)
    path = warc.write_archives(df, storage.new_path(spark, "w"))
    sizes = [spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    try:
        for split in ("3000", "100m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            out = warc.read_archives(spark, path).collect()
            facts = lambda i, h: (i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest())
            assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in out) == Counter(facts(i, h or "") for i, _, h in rows)
            assert all(hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in out if r["record_type"] == "response")
            kind = {}
            for r in out:
                kind.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
            assert kind[1] == [("revisit", 2)] and kind[2] == [("response", None)] and kind[5] == [("revisit", 6)] and kind[10] == kind[11] == [("response", None)]
            assert sorted(kind[8], key=str) == [("response", None), ("revisit", 8)] and sorted(kind[None], key=str) == [("response", None), ("revisit", None)]
            assert next(r["target_uri"] for r in out if r["page_id"] == 2) == "http://b%0D%0Aq"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes[0])
        spark.conf.set("spark.sql.files.openCostInBytes", sizes[1])


def test_warc_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc.write_archives(none, storage.new_path(spark, "w"))
    assert warc.read_archives(spark, path).count() == 0


def brute_links(rows, threshold=0.98):
    ok = {}
    for k, (i, label, v) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64) / max(map(abs, v))) / max(map(abs, v))
    links = {k: {j for j in ok if j != k and rows[j][1] == rows[k][1] and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= threshold} for k in ok}
    far = 1 << 60  # a null id names no component
    comp = {k: far if rows[k][0] is None else rows[k][0] for k in range(len(rows))}
    for _ in rows:
        for k, near in links.items():
            comp[k] = min([comp[k], *(comp[j] for j in near)])
    return Counter((rows[k][0], len(links.get(k, ())), None if comp[k] == far else comp[k], comp[k] == rows[k][0]) for k in comp)


@pytest.mark.parametrize("small", [2, 24])
def test_embeddings_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(embed_dedup, "SMALL", small)
    monkeypatch.setattr(embed_dedup, "TILE", 40)
    monkeypatch.setattr(embed_dedup, "SHARE", 500)
    r = np.random.default_rng(5)
    rows, centres = [], r.normal(size=(6, 24))
    for i in range(260):
        c = centres[r.integers(6)] if i < 200 else centres[0] * r.uniform(0.5, 2)
        rows.append((i, str(i % 2), [float(np.float32(x)) for x in c + r.normal(size=24) * r.choice([0.0, 0.02, 0.05, 0.12])]))
    rows += [(300, "0", None), (301, "0", []), (302, "0", [0.0] * 24), (303, "0", [float("nan")] + [1.0] * 23), (304, "0", [None] + [1.0] * 23), (305, None, rows[0][2]), (306, "0", [1.0]), (307, "0", [2.0]), (308, "0", [-1.0]), (309, "1", [float("inf")] * 24), (None, "0", rows[0][2]), (None, "1", [1.0] + [0.0] * 23), (None, "1", None), (5, "1", rows[5][2])]
    df = spark.createDataFrame([(i, v, label, 1, 2) for i, label, v in rows], "vec_id long, embedding array<float>, label string, leader int, cid int")
    got = Counter(map(tuple, embed_dedup.link_embeddings(df).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute_links(rows)


def test_many_copies_are_one_class(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(500)] + [(500, [1.0, 2.0, 3.001], 1), (501, [1.0, 2.0, 3.0], 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[0] == (500, 0) and got[500] == (500, 0) and got[501] == (0, 501)
    assert embed_dedup.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def hubs(n):
    """Rows of a hub and two ends, each end at cosine 0.985 to the hub, the ends at 0.94 to each other."""
    r = np.random.default_rng(8)
    hub = r.normal(size=(n, 64))
    hub /= np.linalg.norm(hub, axis=1, keepdims=True)
    off = r.normal(size=(n, 64))
    off -= (hub * off).sum(axis=1, keepdims=True) * hub
    off *= np.sqrt(1 - 0.985**2) / np.linalg.norm(off, axis=1, keepdims=True)
    return np.stack([0.985 * hub + off, 0.985 * hub - off, hub], axis=1)


def test_a_hub_of_the_largest_class_joins_its_ends():
    one, two, hub = hubs(1)[0]
    rows = pd.DataFrame({"label": "x", "dims": 64, "leader": 1, "p": 0, "q": 0, "part": 0, "cid": [1, 2, 3], "copies": 1, "leaders": [np.array([1])] * 3, "vec": [one, two, hub]})
    met = embed_dedup._tiles(0.98)(rows).sort_values("cid")
    assert met[["cid", "links", "low"]].to_numpy().tolist() == [[1, 1, 1], [2, 1, 1], [3, 2, 1]]


@pytest.mark.parametrize("small", [2, 24])
def test_every_link_is_in_a_component(spark, monkeypatch, small):
    monkeypatch.setattr(embed_dedup, "SMALL", small)
    vectors = hubs(80)
    rows = [(3 * k + i, vectors[k, i].tolist(), 1) for k in range(80) for i in range(3)]
    got = {r["vec_id"]: r for r in embed_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    whole = [k for k in range(80) if got[3 * k + 2]["n_links"] == 2]
    assert len(whole) > 70
    assert all([got[3 * k + i]["component_id"] for i in range(3)] == [3 * k] * 3 for k in whole)


def test_recall_against_brute_force(spark):
    """Links found among all of some thousand vectors, a third of which are near others at cosines down to the threshold."""
    r = np.random.default_rng(12)
    base = r.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = r.normal(size=(700, 64))
    off -= (base[:700] * off).sum(axis=1, keepdims=True) * base[:700]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = r.uniform(0.9801, 0.9999, size=(700, 1))
    whole = np.concatenate([base, c * base[:700] + np.sqrt(1 - c**2) * off])
    got = sum(x["n_links"] for x in embed_dedup.link_embeddings(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(whole)], "vec_id long, embedding array<double>, label int")).collect())
    links = int(((whole @ whole.T) >= 0.98).sum()) - len(whole)
    assert links >= 1400 and 0.995 * links <= got <= links


def test_unite_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(50):
        n = int(r.integers(1, 40))
        root, label = np.arange(n), list(range(n))
        for _ in range(3):
            a, b = r.integers(n, size=(2, int(r.integers(0, 12))))
            embed_dedup._unite(root, a, b)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                label = [min(label[x], label[y]) if z in (label[x], label[y]) else z for z in label]
        assert root.tolist() == label


def test_recall_at_the_threshold():
    r = np.random.default_rng(2)
    a = r.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(3000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    met = [not set(x).isdisjoint(y) for x, y in zip(embed_dedup.buckets(a).tolist(), embed_dedup.buckets(c).tolist(), strict=True)]
    assert np.mean(met) > 0.999
    assert np.allclose(np.linalg.norm(embed_dedup.hadamard(np.eye(8)), axis=1), 1)


def test_url_rules_against_a_plain_scan(spark):
    r = random.Random(4)
    hosts = ["example.net", "a.example.net", "EXAMPLE.net", "net", "xnet", "org", "w.org", "example.com", "b.example.com", "example.community", "h:80", "", "é.net"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/é?x=/en/", "/EN/", "?a=/en/", "#/en/", "/en/a://b"]
    urls = [None, "", "no scheme", "://", "http://", "x://y://net/"] + ["http://" + r.choice(hosts) + r.choice(paths) for _ in range(300)]
    rules = [*url_filter.RULES, ("block", "", "/x"), ("block", "a.example.net", "/e"), ("allow", "example.com", "/de/x")]

    def plain(url):
        host, path = url_filter.split_url(url)
        fit = [(h + p, a) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, *best

    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {x["id"]: tuple(x)[1:] for x in url_filter.judge_urls(df, rules=rules).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert url_filter.split_url("HTTP://AbC.Net:8/P?q") == ("abc.net:8", "/P")
    with pytest.raises(ValueError, match="rules"):
        url_filter.RuleIndex([("block", "x", "/")] * (url_filter.MAX_RULES + 1))


def test_url_rules_on_an_empty_table(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_queries_leave_the_session_alone(spark):
    from lexiloom.llm import queries

    before = dict(spark.conf.getAll)
    for run in queries.QUERIES.values():
        run(spark, "/root/testdata/sf0.001").count()
    assert dict(spark.conf.getAll) == before


def test_pipeline_of_an_empty_table_and_of_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    for name, rows in (("none", []), ("clash", [(1, "und die nicht ein auch sich werden", "de", 1, 2, 3, "x"), (2, None, None, 1, 2, 3, "x"), (None, "der die das und nicht ein auch", "de", 1, 2, 3, "x")])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, __id int, gone int, kept string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "some item of the benchmark")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in P.STAGES[:-1]:
            docs, _ = storage.durable(f(spark, docs, folder), stage)
            assert docs.columns == ["doc_id", "text", "lang", "score", "__id", "gone", "kept"]
        assert {x["doc_id"] for x in P.run(spark, folder).collect()} == ({1, None} if rows else set())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(9)
    pool = "der die und mit nicht ein auch sich werden haben durch über unter gegen ohne dann wenn aber weil".split()
    text = lambda n: " ".join(r.choice(pool) + r.choice(["", "en", "er", "st"]) for _ in range(n))
    shared, item = text(40), text(30)
    rows = [(i, text(80), "de") for i in range(20)]
    rows += [(30, rows[0][1], "de"), (31, "12345 !!", "de"), (32, None, "de"), (33, text(30) + " " + shared, "de"), (34, text(30) + " " + shared, "de"), (35, text(20) + " " + item + " " + text(20), "de"), (36, shared, "de")]
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in P.STAGES:
        docs, _ = storage.durable(stage(spark, docs, folder), name)
        seen.append({x["doc_id"] for x in docs.collect()})
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    every = {i for i, _, _ in rows}
    assert seen[0] == every - {31, 32}
    assert seen[1] == seen[0] - {30}
    assert seen[2] == seen[1] - {36} and seen[3] == seen[4] == seen[2] - {35}
    final = {x["doc_id"]: x for x in P.run(spark, folder).collect()}
    assert set(final) == seen[4]
    assert final[0]["decoded_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest() and final[33]["n_tokens"] > final[34]["n_tokens"]
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "byte_bpe"]


def test_names_with_dots_are_columns(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "some text"), (2, None, "some text")], "`the.id` long, `the.url` string, `the.text` string")
    assert url_filter.judge_urls(df, "the.id", "the.url").where("verdict = 'block'").count() == 1
    assert {r.n_tokens for r in token_store.encode_chunks(df, JSON, 2, "the.id", "the.text", 2).collect()} == {3}


def test_rules_are_compiled_when_they_are_asked_for():
    index = url_filter.RuleIndex([("block", f"host{i}.net", "/") for i in range(5000)])
    assert not index.patterns and index.decide("a.host7.net", "/x") == ("host7.net/", "block") and len(index.patterns) == 1


def test_a_hot_vector_is_one_class(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(4, 16))
    rows = [(i, base[0].tolist(), 1) for i in range(400)] + [(1000 + i, (base[k] + r.normal(scale=1e-3, size=16)).tolist(), 1) for i, k in enumerate([0, 1, 1, 2])] + [(None, base[3].tolist(), 2)] * 300
    got = embed_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)).collect()
    assert len(got) == len(rows)
    found = {x.vec_id: (x.n_links, x.component_id) for x in got}
    assert all(found[i] == (400, 0) for i in range(400)) and found[1000] == (400, 0) and found[1001] == (1, 1001) == found[1002] and found[1003] == (0, 1003)
    assert [(x.n_links, x.component_id) for x in got if x.vec_id is None] == [(299, None)] * 300
