"""The JSON-lines data source, the journal, table digests and file audits."""

import gzip
import hashlib
import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.operators import sampling
from lexiloom.operators.acquire import Source, acquire
from lexiloom.plans import corpus
from lexiloom.sources import artifacts, digest, journal, jsonsource, registry


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- JSON lines --------------------------------------------------------------------


class Stream:
    """A file that gives a few bytes a read."""

    def __init__(self, data, at, size):
        self.data, self.at, self.size = data, at, size

    def read(self, _):
        piece = self.data[self.at : self.at + self.size]
        self.at += len(piece)
        return piece


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: b.replace(b"\n", b"x")), max_size=8), st.booleans(), st.integers(1, 12), st.integers(1, 5))
def test_every_line_is_in_one_range(lines, closed, step, size):
    data = b"\n".join(lines) + b"\n" * closed
    found = []
    for start in range(0, len(data), step):
        stream = Stream(data, max(0, start - 1), size)
        found += list(jsonsource.lines_of(stream, start, min(start + step, len(data))))
    want, at = [], 0
    for line in data.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    assert [x for x in found if x[1]] == [x for x in want if x[1]]


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


MIXED = b'\xef\xbb\xbf{"id":"1","n":2,"o":{"k":[1,2]}}\n\n  \t\n{"id":"\xc3\xa9"}\r\n{"id":5,"n":7}\n{"id":{"a":[1,"\xc3\xa9"]},"n":null,"x":1}\n{"id":true,"n":1,"n":4}'


@pytest.mark.parametrize("step", [1, 4, 17, 10_000])
def test_ranges_marks_and_blank_lines(spark, tmp_path, step):
    write(tmp_path / "d", "a.jsonl", MIXED)
    write(tmp_path / "d", "_SUCCESS", b"")
    write(tmp_path / "d", ".hidden", b"no")
    got = jsonsource.read(spark, str(tmp_path / "d"), "id string, n long, o struct<k:array<long>>, _offset long", rangeBytes=step)
    at = MIXED.index
    assert [(r.id, r.n, r.o and r.o.k, r._offset) for r in got.orderBy("_offset").collect()] == [("1", 2, [1, 2], 0), ("é", None, None, at(b'{"id":"\xc3')), ("5", 7, None, at(b'{"id":5')), ('{"a":[1,"é"]}', None, None, at(b'{"id":{')), ("true", 4, None, at(b'{"id":true'))]


BAD = b'[{"id":"1"}]\n{"id":"2"}\n{x\n{"n":"no"}\n{"id":"\xff"}\n{"id":"3"}{"id":"4"}\n{"id":"\\ud800"}\nnull\n{"id":"5","n":1.5}\n5\n"x"\n{"id":\n"6"}\n'


def test_bad_lines_raise_or_are_told_with_their_offset(spark, tmp_path):
    write(tmp_path / "d", "b.jsonl", BAD)
    got = jsonsource.read(spark, str(tmp_path / "d"), "id string, n long, _offset long, _error string, _path string").collect()
    lines = BAD.split(b"\n")[:-1]
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    assert sorted(r._offset for r in got) == starts
    assert [r.id for r in got if r._error is None] == ["2"] and all(r.id is None for r in got if r._error) and all(r._path.endswith("b.jsonl") for r in got)
    write(tmp_path / "e", "c.jsonl", b'{"id":"1"}\n[1]\n')
    with pytest.raises(Exception, match="c.jsonl at byte 11: a JSON list"):
        jsonsource.read(spark, str(tmp_path / "e"), "id string").collect()


def test_long_lines_packed_files_and_many_files(spark, tmp_path):
    long = "é" * 3_000_000
    write(tmp_path / "d", "a.jsonl", json.dumps({"id": long}, ensure_ascii=False).encode() + b'\n{"id":"b"}\n')
    write(tmp_path / "d", "b.jsonl.gz", gzip.compress(b'{"id":"c"}\n{"id":"d"}\n' * 1000))
    write(tmp_path / "d", "empty.jsonl", b"")
    (tmp_path / "d" / "sub").mkdir()
    write(tmp_path / "d" / "sub", "x.jsonl", b'{"id":"e"}')
    got = jsonsource.read(spark, str(tmp_path / "d"), "id string", rangeBytes=1 << 20)
    assert {r.id if len(r.id) < 9 else len(r.id): r["count"] for r in got.groupBy("id").count().collect()} == {3_000_000: 1, "b": 1, "c": 1000, "d": 1000, "e": 1}


def test_empty_folders_and_missing_paths(spark, tmp_path):
    (tmp_path / "d").mkdir()
    assert jsonsource.read(spark, str(tmp_path / "d"), "id string").count() == 0
    with pytest.raises(Exception, match="nothing|FileNotFound"):
        jsonsource.read(spark, str(tmp_path / "nothing"), "id string").count()
    with pytest.raises(Exception, match="at least"):
        jsonsource.read(spark, str(tmp_path / "d"), "id string", rangeBytes=0).count()


def test_folders_give_columns(spark, tmp_path):
    from lexiloom import cli
    from lexiloom.sources import jsonl

    df = spark.createDataFrame([("a", 1, "train"), ("b", 2, "a b/c"), ("c", 3, None)], "id string, n long, split string")
    jsonl.write(df, str(tmp_path / "o"), ["split"])
    got = cli._read(spark, str(tmp_path / "o"))
    assert rows_of(got.select("id", "n", "split")) == rows_of(df)
    assert rows_of(got.where("split = 'train'").select("id")) == [("a",)]
    # a table whose schema does not ask for it
    assert rows_of(jsonsource.read(spark, str(tmp_path / "o"), "id string")) == [("a",), ("b",), ("c",)]


def test_filters_reach_the_reader(spark, tmp_path):
    rows = [{"id": x, "n": n} for x, n in (("a", 1), ("b", None), (None, 3), ("ab", 4), ("B", 5), ("", 6))]
    write(tmp_path / "d", "a.jsonl", "\n".join(map(json.dumps, rows)).encode())
    wheres = ["id = 'a'", "id <=> null", "n > 2", "n >= 3 and n < 6", "n <= 4", "id in ('a', 'b')", "id not in ('a')", "id is null", "id is not null", "id like 'a%'", "id like '%b'", "id like '%b%'", "not (n = 3)", "id <=> 'a'", "not (id <=> 'a')", "n in (1, 5)"]
    plain = spark.createDataFrame([(r["id"], r["n"]) for r in rows], "id string, n long")
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        for on in ("true", "false"):
            spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
            for w in wheres:
                df = jsonsource.read(spark, str(tmp_path / "d"), "id string, n long").where(w)
                assert rows_of(df) == rows_of(plain.where(w)), (w, on)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        plan = jsonsource.read(spark, str(tmp_path / "d"), "id string, n long").where("n > 2")._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.replace("RuntimeFilters", "")
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_first_rows_are_bounded_in_every_range(spark, tmp_path):
    write(tmp_path / "d", "b.jsonl", b"".join(b'{"n":%d}\n' % i for i in range(1000, 2000)))
    write(tmp_path / "d", "a.jsonl", b"".join(b'{"n":%d}\n' % i for i in range(1000)))
    got = jsonsource.first_rows(spark, str(tmp_path / "d"), "n long", 7, rangeBytes=500)
    assert [r.n for r in got.collect()] == list(range(7))
    assert jsonsource.read(spark, str(tmp_path / "d"), "n long", rangeBytes=500, limit=2).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] == 2
    assert jsonsource.first_rows(spark, str(tmp_path / "d"), "n long", 0).count() == 0


def test_revisions_are_pinned(spark, tmp_path):
    write(tmp_path / "v1", "a.jsonl", b'{"text":"one"}\n')
    write(tmp_path / "v2", "a.jsonl", b'{"text":"two"}\n{"text":"three"}\n')
    assert jsonsource.read(spark, str(tmp_path), "text string", revision="v1").first().text == "one"
    source = Source("s", "json", str(tmp_path), "c", revision="v2")
    assert [r.text for r in registry.numbered(spark, source, "i").orderBy("i").collect()] == ["two", "three"]
    for bad in ("v3", "../x", "v1/.."):
        with pytest.raises(Exception, match="revision"):
            registry.load(spark, Source("s", "json", str(tmp_path), "c", revision=bad))
        with pytest.raises(Exception, match="revision"):
            jsonsource.read(spark, str(tmp_path), "text string", revision=bad).count()


def test_acquire_and_prepare_read_through_the_source(spark, tmp_path):
    texts = [f"A sentence long enough for the general category, number {i} of them, surely long enough to stay in: {'abcdefgh'[i] * 5} {i * 77}" for i in range(8)]
    write(tmp_path / "d", "a.jsonl", b"\xef\xbb\xbf" + b"\n".join(json.dumps({"text": t, "work": f"w{i}"}).encode() for i, t in enumerate(texts)))
    write(tmp_path / "bad", "a.jsonl", b'{"text":"x"}\n[1]\n')
    sources = [Source("good", "json", str(tmp_path / "d"), "general_en", max_documents=5), Source("bad", "json", str(tmp_path / "bad"), "general_en")]
    frames, report = acquire(spark, sources, lambda s: registry.numbered(spark, s, "__n"), "__n", 1)
    found = {r["name"]: r for r in report.collect()}
    assert found["good"]["rows"] == 5 and found["bad"]["rows"] == 0 and "at byte 13" in found["bad"]["error"]
    records = frames["good"].orderBy("id").collect()
    assert [r.id for r in records] == [f"good:{i}" for i in range(5)] and [r.text for r in records] == texts[:5]
    read = jsonsource.read(spark, str(tmp_path / "d"), "text string, work string").withColumn("category", F.lit("general_en"))
    kept = corpus.prepare(sampling.ordinals(read, "n"), "n", fingerprint="sha256").where("size(reasons) = 0")
    assert kept.count() >= 1


def test_ordinals_follow_the_scan(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).toDF("part")
    got = sampling.ordinals(df, "before").collect()
    assert [(r.part, r.before) for r in got] == [(i, i) for i in range(1000)]
    assert sampling.number(df.toDF("number").repartition(5), ["number"], "at").where("number <> at").count() == 0
    assert sampling.ordinals(df.limit(0), "n").count() == 0


# --- the journal ---------------------------------------------------------------------


def test_a_run_that_dies_keeps_what_finished(spark, tmp_path):
    def failing(frames):
        import time

        for pdf in frames:
            if (pdf["id"] == "k7").any():
                time.sleep(3)  # the others finish meanwhile
                raise RuntimeError("lost")
            yield pdf.assign(said=pdf["id"] + "!")[["id", "said"]]

    def answering(frames):
        for pdf in frames:
            yield pdf.assign(said=pdf["id"] + "!")[["id", "said"]]

    tasks = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "id string, n int")
    path, schema = str(tmp_path / "j"), "id string, said string"
    assert journal.committed(spark, path, schema, "id").count() == 0
    with pytest.raises(Exception, match="lost"):
        journal.run_pending(tasks, path, "id", lambda d: d.mapInPandas(failing, schema), rows=3)
    kept = {r.id for r in journal.committed(spark, path, schema, "id").collect()}
    assert 0 < len(kept) < 40 and "k7" not in kept
    asked = []
    done = journal.run_pending(tasks, path, "id", lambda d: (asked.append({r.id for r in d.collect()}), d.mapInPandas(answering, schema))[1], rows=3)
    assert done == 40 - len(kept) and asked == [{f"k{i}" for i in range(40)} - kept]
    assert rows_of(journal.committed(spark, path, schema, "id")) == sorted((f"k{i}", f"k{i}!") for i in range(40))
    assert journal.run_pending(tasks, path, "id", lambda d: d.mapInPandas(answering, schema)) == 0


def test_the_same_keys_are_published_once(spark, tmp_path):
    path = str(tmp_path / "j")
    for said in ("first", "second"):
        journal.append(spark.createDataFrame([("a", said), (None, said)], "id string, said string").coalesce(1), path, "id")
    assert len(list((tmp_path / "j").glob("*.parquet"))) == 1
    journal.append(spark.createDataFrame([("a", "third"), ("b", "third")], "id string, said string").coalesce(1), path, "id")
    assert {r.id for r in journal.committed(spark, path, "id string, said string", "id").collect()} == {"a", "b", None}
    assert journal.committed(spark, path, "id string, said string", "id").count() == 3
    assert journal.run_pending(spark.createDataFrame([(None,), ("b",), ("c",)], "id string"), path, "id", lambda d: d.withColumn("said", F.lit("x"))) == 1


def test_a_journal_takes_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "id string, file int, row int")
    assert journal.run_pending(df, str(tmp_path / "j"), "id", lambda d: d) == 2
    assert rows_of(journal.committed(spark, str(tmp_path / "j"), df.schema, "id")) == [("a", 1, 2), ("b", 3, 4)]
    assert journal.run_pending(df.limit(0), str(tmp_path / "k"), "id", lambda d: d) == 0


# --- digests ---------------------------------------------------------------------------


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "b string, a long, m map<string,int>, x binary, s struct<p:int>, f int").repartition(parts)


ROWS = [(None if i % 5 == 0 else f"t{i}", i % 7, {"k": i, "j": 1}, bytes([i]), (i,), i) for i in range(60)]


def test_digests_ignore_order_and_place(spark):
    want = digest.table_digest(table(spark, ROWS))
    shuffled = random.Random(1).sample(ROWS, len(ROWS))
    assert want["rows"] == 60 and len(want["sha256"]) == 64
    assert digest.table_digest(table(spark, shuffled, 7).select("x", "f", "m", "b", "s", "a")) == want
    flipped = [(b, a, dict(reversed(m.items())), x, s, f) for b, a, m, x, s, f in ROWS]
    assert digest.table_digest(table(spark, flipped)) == want


@pytest.mark.parametrize("change", [lambda r: ("", *r[1:]), lambda r: (r[0], r[1] + 1, *r[2:]), lambda r: (*r[:3], b"", *r[4:]), lambda r: (*r[:4], (None,), r[5])])
def test_one_changed_row_changes_the_digest(spark, change):
    first, second = table(spark, ROWS), table(spark, [change(ROWS[0]), *ROWS[1:]])
    assert digest.table_digest(first)["sha256"] != digest.table_digest(second)["sha256"]
    got = digest.differing_rows(first, second).collect()
    assert sorted((r.in_first, r.in_second) for r in got) == [(0, 1), (1, 0)]
    assert 1 <= digest.differing_leaves(first, second).count() <= 2


def test_repeated_rows_and_empty_tables(spark):
    first, second = table(spark, ROWS + ROWS[:1]), table(spark, ROWS)
    assert digest.table_digest(first)["sha256"] != digest.table_digest(second)["sha256"]
    assert [(r.in_first, r.in_second) for r in digest.differing_rows(first, second).collect()] == [(2, 1)]
    empty = digest.table_digest(table(spark, []))
    assert empty["rows"] == 0 and empty["sha256"] != digest.table_digest(spark.createDataFrame([], "a int"))["sha256"]
    assert digest.differing_rows(second, second).count() == 0 and digest.tree(table(spark, [])).count() == 0


def test_values_do_not_run_together(spark):
    make = lambda a, b: digest.table_digest(spark.createDataFrame([(a, b)], "a string, b string"))["sha256"]
    assert len({make("xy", ""), make("x", "y"), make("", "xy"), make("s1:x", "y"), make(None, "xy"), make("n", "xy")}) == 6


def test_tree_nodes_hash_their_children(spark):
    nodes = {r.prefix: r for r in digest.tree(table(spark, ROWS), 2).collect()}
    for k in range(2):
        for p in [p for p in nodes if len(p) == k]:
            children = sorted(c for c in nodes if len(c) == k + 1 and c.startswith(p))
            assert nodes[p].digest == hashlib.sha256(";".join(f"{c}={nodes[c].digest}" for c in children).encode()).hexdigest()
            assert nodes[p].rows == sum(nodes[c].rows for c in children)


# --- files ---------------------------------------------------------------------------------


def test_audits_go_by_relative_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "BUFFER", 7)
    for folder, data in (("a", b"one"), ("b c", b"two" * 50)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "config.json").write_bytes(data)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = spark.createDataFrame([("a/config.json", sha(b"one")), ("b c/config.json", sha(b"one")), ("config.json", sha(b"one")), ("a/config.json", None)], "path string, sha256 string")
    got = sorted((r.path, r.exists, r.matches, r.length) for r in artifacts.audit_files(spark, str(tmp_path), want).collect())
    assert got == [("a/config.json", True, True, 3), ("a/config.json", True, True, 3), ("b c/config.json", True, False, 150), ("config.json", False, False, None)]


def test_resources_check_their_model_file(spark, tmp_path):
    (tmp_path / "m" / "deep").mkdir(parents=True)
    (tmp_path / "m" / artifacts.MODEL_FILE).write_bytes(b"weights")
    (tmp_path / "m" / "deep" / "x").write_bytes(b"x")
    (tmp_path / "f.bin").write_bytes(b"file")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = [("model", "m", None, sha(b"weights").upper()), ("wrong", "m", None, "0"), ("file", "f.bin", sha(b"file"), None), ("gone", "g", "0", "0"), ("inner", "m/deep", None, "0")]
    got = artifacts.audit_resources(spark, str(tmp_path), spark.createDataFrame(rows, "name string, path string, sha256 string, model_sha256 string")).collect()
    assert {r["name"]: (r.exists, r.hash_matches, r.model_hash_matches) for r in got} == {"model": (True, None, True), "wrong": (True, None, False), "file": (True, True, None), "gone": (False, None, None), "inner": (True, None, None)}


def test_arrow_paths():
    assert jsonsource.file_system("file:/tmp/a b")[1] == "/tmp/a b" == jsonsource.file_system("file:///tmp/a b")[1]
    assert isinstance(jsonsource.file_system("/tmp")[0], pa.fs.LocalFileSystem)
