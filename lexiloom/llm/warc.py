"""WARC archives: writing with payload revisits, reading with boundary-chain verification.

Writing.  Each page is one record.  Of pages with equal payloads of at least
``REVISIT_BYTES`` the one with the largest id is the ``response``, the others
are ``revisit`` records without a body that name it; smaller payloads are all
responses.  Records are written by Spark's own text sink, whose line separator
is the end of a record, so the archives are plain WARC/1.0 files in any store
that Spark writes.

Reading.  Tasks split the files at every occurrence of the magic
``WARC/1.0\\r\\n``; each is a candidate, at a known offset, and its header
says where its successor must be.  A payload may hold the magic, even a whole
record.  Pointer jumping from the start of each file keeps only the candidates
that the chain of records reaches: each task first shortens the pointers
within its split, then splits are linked by doubling.  A record whose body
holds the magic is put together from its pieces in a second read that fetches
only those pieces.

Defined cases: a null payload is empty; a null URL leaves its header out and
line ends in URLs are percent-encoded; records without an id come back with a
null id and are never what a revisit refers to unless all of the copies have
none; of copies that share the largest id, one is the response; an empty table
gives no record; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import durable, new_path, slices

REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: The HTTP head in front of every payload and the profile of revisits.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_FACTS = "file long, block long, ord long, len long, need long"
_RECORD = "page_id long, record_type string, target_uri string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def mark_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``id, url, payload, size, digest, is_revisit, refers``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    # one small row for each large payload that repeats: the id of its response
    large = rows.where(F.col("size") >= REVISIT_BYTES).select("id", "digest")
    copied, _ = durable(large.groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1"), "copied")
    twins = large.join(copied, "digest").where("id <=> keeper").groupBy("digest").count().where("count > 1")
    met = rows.join(copied, "digest", "left").withColumn("turn", F.lit(1))
    if not twins.isEmpty():
        # rows that share the largest id of their payload: one of them is the response
        met = met.withColumn("turn", F.row_number().over(Window.partitionBy("digest", "id").orderBy("url")))
    stays = F.col("copies").isNull() | (F.col("id").eqNullSafe(F.col("keeper")) & (F.col("turn") == 1))
    return met.select("id", "url", "payload", "size", "digest", (~stays).alias("is_revisit"), F.when(~stays, F.col("keeper")).alias("refers"))


def _header(name: str, value):
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> str:
    """Write a record for every row under ``path``, which is returned."""
    marked = mark_revisits(pages, id_col, url_col, payload_col)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC), F.when(F.col("is_revisit"), "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"), F.lit("WARC-Record-ID: "), urn(F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\n"), _header("WARC-Target-URI", url),
        F.when(F.col("is_revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("refers")), F.lit("\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.when(F.col("is_revisit"), F.lit(len(HTTP))).otherwise(F.col("size") + len(HTTP)).cast("string"), F.lit(f"\r\n\r\n{HTTP}"),
    )
    record = F.concat(head, F.when(F.col("is_revisit"), "").otherwise(F.col("payload")))
    marked.select(record.alias("value")).write.option("lineSep", END).text(path)
    return path


class Piece:
    """What stands between two magics, read as a record."""

    def __init__(self, raw: bytes):
        self.raw = raw
        split = raw.find(b"\r\n\r\n")
        self.head = raw[:split].decode("latin-1") if split > 0 else ""
        length = self.field("Content-Length")
        self.body = split + len(END)
        self.content = int(length) if length.isdigit() else None
        #: length of the whole record without its magic; None if this cannot be one
        self.need = None if self.content is None else self.body + self.content + len(END)

    def field(self, name: str) -> str:
        found = re.search(rf"^{name}:[ \t]*([^\r\n]*)", self.head, re.IGNORECASE | re.MULTILINE)
        return found[1].strip() if found else ""

    def _page(self, name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", self.field(name))
        return int(found[1]) if found else None

    def record(self, with_payload: bool) -> tuple:
        kind, digest = self.field("WARC-Type"), self.field("WARC-Payload-Digest").removeprefix("sha1:")
        url = self.field("WARC-Target-URI") or None
        url = url and url.encode("latin-1").decode()
        if kind == "revisit":
            size = self.field("WARC-Payload-Length")
            return self._page("WARC-Record-ID"), kind, url, self._page("WARC-Refers-To"), None, int(size) if size.isdigit() else None, digest
        content = self.raw[self.body : self.body + (self.content or 0)]
        payload = content[content.find(b"\r\n\r\n") + len(END) :]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {self.field('WARC-Record-ID')} does not fit its digest {digest}")
        return self._page("WARC-Record-ID"), kind, url, None, payload if with_payload else None, len(payload), digest


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(file, block, order in the split, piece) of a task's rows, which come in file order."""
    last, n = None, 0
    for batch in slices(batches):
        out = []
        for file, block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = n + 1 if (file, block) == last else 0
            last = file, block
            out.append((file, block, n, raw))
        yield out


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every piece between magics, with its file (hashed) and the start of its split."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").cast("long").alias("block"), F.col("value").cast("binary").alias("piece"))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _numbered(batches):
        yield _table([(f, b, n, len(raw), Piece(raw).need) for f, b, n, raw in rows], _FACTS)


def _placed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _numbered(batches):
        yield _table(rows, "file long, block long, ord long, piece binary")


def _shorten(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follow each candidate's pointer to where it leaves its split (-1: it leads nowhere)."""
    pdf = pdf.sort_values("at", ascending=False)
    leave: dict[int, int] = {}
    for at, to in zip(pdf["at"].tolist(), pdf["next"].tolist(), strict=True):
        # pointers only go forward, so what this one points at is settled
        leave[at] = -1 if to != to else leave.get(int(to), int(to))
    return pdf[["file", "at"]].assign(exit=[leave[a] for a in pdf["at"]])


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a split that the chain passes, given where it enters; ``owner`` is the last one passed."""
    pdf = pdf.sort_values("at")
    live = {int(e) for e in pdf["enter"].dropna()}
    real, owner, own = [], [], None
    for at, to in zip(pdf["at"].tolist(), pdf["next"].tolist(), strict=True):
        real.append(at in live)
        if real[-1]:
            own = at
            if to == to:
                live.add(int(to))
        owner.append(own)
    return pdf[["file", "block", "ord", "at"]].assign(real=real, owner=pd.array(owner, "Int64"))


def verify_chain(facts: DataFrame, rows: int) -> DataFrame:
    """``file, block, ord, len, need`` of all pieces -> ``file, block, ord, at, real, owner``.

    ``at`` is the offset of the piece's magic, ``real`` whether the chain of
    records from the file's start reaches it, ``owner`` the record that it
    lies in (null: the last one of the file's earlier splits).  ``rows`` is
    the number of pieces.
    """
    jump = len(MAGIC)
    # these tables pack far smaller on disk than in memory, so no join is left to a guess of their size
    # offsets: sums within a split, then over the splits of a file (a row each)
    inside = Window.partitionBy("file", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = facts.groupBy("file", "block").agg(F.sum(F.col("len") + jump).alias("bytes"))
    bases = splits.select("file", "block", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base"))
    at = F.col("base") + F.coalesce(F.sum(F.col("len") + jump).over(inside), F.lit(0)) - jump
    placed = facts.join(bases.hint("merge"), ["file", "block"]).withColumn("at", at).withColumn("next", F.col("at") + jump + F.col("need"))
    # what stands before a file's first magic (nothing) is no candidate
    placed, _ = durable(placed.where("at >= 0").select("file", "block", "ord", "at", "next"), "candidates", rows)

    pointers, _ = durable(placed.groupBy("file", "block").applyInPandas(_shorten, "file long, at long, exit long").where("exit >= 0"), "pointers", rows)
    reach = placed.where("at = 0").select("file", F.col("at").alias("enter"))
    while True:  # after k rounds: all entries within 2^k splits of the file's start
        gained = reach.withColumnRenamed("enter", "at").join(pointers.hint("merge"), ["file", "at"]).select("file", F.col("exit").alias("enter"))
        reach, _ = durable(reach.union(gained).distinct(), "reach", rows)
        further = pointers.withColumnRenamed("exit", "via").join(pointers.select("file", F.col("at").alias("via"), "exit").hint("merge"), ["file", "via"]).select("file", "at", "exit")
        pointers, _ = durable(further, "pointers", rows)
        if pointers.isEmpty():
            break
    entered = placed.join(reach.select("file", F.col("enter").alias("at"), "enter").hint("merge"), ["file", "at"], "left")
    return entered.groupBy("file", "block").applyInPandas(_mark, "file long, block long, ord long, at long, real boolean, owner long")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """``page_id, record_type, target_uri, refers_to, payload, payload_bytes, payload_digest`` of every record.

    ``payload`` is null in revisits, whose length and digest are those in their
    headers.  Raises if a response's payload does not fit its digest.
    """
    facts, _ = durable(_pieces(spark, path).mapInArrow(_facts, _FACTS), "pieces")
    rows = facts.count()
    chain, _ = durable(verify_chain(facts, rows), "chain", rows)
    last = chain.where("real").groupBy("file", "block").agg(F.max("at").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = chain.select("file", "block").distinct().join(last.hint("merge"), ["file", "block"], "left").select("file", "block", F.max("last").over(before).alias("carried"))
    owned = chain.join(carried.hint("merge"), ["file", "block"]).select("file", "block", "ord", "at", F.coalesce("owner", "carried").alias("owner"))
    # records in several pieces: those with the magic in their body
    torn = owned.groupBy("file", "owner").count().where("count > 1").select("file", "owner")
    apart, _ = durable(owned.join(torn.hint("merge"), ["file", "owner"]).select("file", "block", "ord", "at", "owner"), "apart", rows)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _table([Piece(raw).record(with_payload) for raw in batch.column(2).to_pylist() if raw], _RECORD)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _table([Piece(raw).record(with_payload) for raw in batch.column(0).to_pylist() if raw], _RECORD)

    if apart.isEmpty():
        return _pieces(spark, path).mapInArrow(at_once, _RECORD)  # every piece is a record
    found = _pieces(spark, path).mapInArrow(_placed_pieces, "file long, block long, ord long, piece binary")
    whole = found.join(apart.select("file", "block", "ord"), ["file", "block", "ord"], "left_anti").select("piece")
    pieces = found.join(apart, ["file", "block", "ord"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    glue = F.expr("aggregate(slice(p, 2, size(p)), p[0].piece, (a, x) -> concat(a, magic, x.piece))")
    glued = pieces.withColumn("magic", F.lit(MAGIC).cast("binary")).select(glue.alias("piece"))
    return whole.union(glued).mapInArrow(records, _RECORD)


def archive_path(spark: SparkSession) -> str:
    return new_path(spark, "warc")
