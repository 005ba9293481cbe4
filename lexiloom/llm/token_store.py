"""Token-id output as a content-addressed store.

Each document's ids are cut into chunks where a rolling hash over the last few
ids says so (within least and greatest lengths), so equal passages cut alike.
The store is four Parquet tables:

``chunks``     digest (SHA-256 of the ids as written), n_ids, ids - each once
``recipes``    doc_id, start, n_tokens, chunks (digests in order), root
``manifests``  segment, first and last place, documents, tokens, root
``_about``     id width in bytes and the cutting parameters

A recipe's root is the Merkle root of its chunk digests, a manifest's that of
the roots of a run of recipes in ascending doc_id order.  Reading checks every
chunk against its digest, every recipe and every manifest against its root.
``start`` counts the ids of all documents before it; the prefix sum runs over
range partitions and one row for each of them.

Defined cases: a null text counts as empty (one end id); documents with equal
ids are ordered by a hash of their ids and then alike; null ids come first;
an added token of the vocabulary that stands in a text, such as an end mark, is
that token, as in the library's own call; an empty table gives empty tables;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from .pretokens import WordTable, code_points, gather, span_hashes, split_points
from .storage import drop_path, durable, new_path, shuffle_width, slices

#: Least, usual and greatest ids in a chunk; ids that the rolling hash looks back on.
LEAST, USUAL, GREATEST, LOOK_BACK = 128, 512, 4096, 8
#: Documents in a manifest.
SEGMENT = 10_000
#: Distinct pre-tokens that a worker keeps the ids of.
CACHE_WORDS, CACHE_BITS = 1_200_000, 21
#: Range partitions whose sums are broadcast.
MOST_PARTS = 100_000
#: Words that the library gets as one text.
ROW = 500

_ENCODED = "doc_id long, n_tokens long, chunks array<struct<digest:binary,n_ids:int,ids:binary>>"


def cut(ids: np.ndarray, least: int = LEAST, usual: int = USUAL, greatest: int = GREATEST) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= least:
        return [n] if n else []
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    rolled = np.zeros(n, dtype=np.uint64)
    factor = 1
    for back in range(LOOK_BACK):
        rolled[back:] += x[: n - back] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    wanted = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(usual) == 0) + 1
    ends, at = [], 0
    for w in [*wanted.tolist(), n]:
        while w - at > greatest:
            at += greatest
            ends.append(at)
        if w - at >= least or w == n:
            at = w
            ends.append(at)
    return ends if not ends or ends[-1] == n else [*ends, n]


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd digest moves up alone."""
    if not digests:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class CachedEncoder:
    """The tokenizers library, asked once for each distinct pre-token that is kept.

    ``plain``: added tokens that stand in a text are ordinary text.
    """

    split = staticmethod(split_points)
    cache_words, cache_bits = CACHE_WORDS, CACHE_BITS

    def __init__(self, path: str, plain: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        #: texts with one of these are left to the library as they are
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content and not (plain and t.special)]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: bytes of each token: a byte-level token has a character for each byte
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._clear()

    def _clear(self):
        self.table = WordTable(self.cache_bits)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.sizes = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and each word's count.

        Words of letters with a space in front part by themselves when they
        stand in a row, so the library gets them as a few texts; where one
        ends is told by the bytes of its tokens.
        """
        apart = np.fromiter((w[0] != " " or not w[1:].isalpha() for w in words), bool, len(words))
        sizes = np.zeros(len(words), dtype=np.int64)
        together, alone = np.flatnonzero(~apart), np.flatnonzero(apart)
        own = [words[i] for i in together.tolist()]
        rows = ["".join(own[at : at + ROW]) for at in range(0, len(own), ROW)]
        if any(t in row for row in rows for t in self.added):  # of letters, made up by neighbours
            together, own, rows, apart[:] = together[:0], [], [], True
            alone = np.arange(len(words))
        flat = np.array([i for e in self.library.encode_batch_fast(rows, add_special_tokens=False) for i in e.ids], dtype=np.uint32)
        if len(together):
            ends = np.cumsum(np.fromiter((len(w.encode()) for w in own), np.int64, len(own)))
            reached = np.cumsum(self.bytes[flat])
            last = np.minimum(np.searchsorted(reached, ends), len(reached) - 1)
            if (reached[last] == ends).all() and last[-1] == len(reached) - 1:
                sizes[together] = np.diff(last, prepend=-1)
            else:  # a token across words: never for such vocabularies
                alone, together, flat = np.arange(len(words)), together[:0], flat[:0]
        coded = [e.ids for e in self.library.encode_batch_fast([words[i] for i in alone.tolist()], add_special_tokens=False)]
        sizes[alone] = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.concatenate([flat, np.array([i for ids in coded for i in ids], dtype=np.uint32)])
        # back from (together, alone) to the order given
        order = np.concatenate([together, alone])
        ends = np.cumsum(sizes[order])
        starts = np.empty(len(words), dtype=np.int64)
        starts[order] = ends - sizes[order]
        return gather(flat, starts, sizes, np.arange(len(words)))[0], sizes

    def _learn(self, words: list[str]) -> None:
        """Ids of the words that the table got last."""
        flat, sizes = self.encode_words(words)
        first = self.table.count - len(words)
        while self.table.count > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.sizes, self.sizes * 0])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.flat[self.used : self.used + len(flat)] = flat
        ends = self.used + np.cumsum(sizes)
        self.starts[first : self.table.count], self.sizes[first : self.table.count] = ends - sizes, sizes
        self.used += len(flat)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as the library's own call gives them."""
        special = [bool(x) and any(t in x for t in self.added) for x in texts]
        out = self._encode_plain([None if own else x for x, own in zip(texts, special, strict=True)])
        for k in np.flatnonzero(special).tolist():
            out[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
        return out

    def _encode_plain(self, texts: list[str | None]) -> list[np.ndarray]:
        codes, bases = code_points(texts)
        begins, ends = self.split(codes)
        a, b = span_hashes(codes, begins, ends)
        rows = self.table.find(a, b)
        if (rows < 0).any() and self.table.count > self.cache_words:
            self._clear()
            rows[:] = -1
        new = np.flatnonzero(rows < 0)
        if len(new):
            order = new[np.lexsort((b[new], a[new]))]
            fresh = np.append(True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))
            heads = order[fresh]
            text = np.searchsorted(bases, begins[heads], side="right") - 1
            words = [texts[t][i:j] for t, i, j in zip(text.tolist(), (begins[heads] - bases[text]).tolist(), (ends[heads] - bases[text]).tolist(), strict=True)]
            own = self.table.add(a[heads], b[heads])
            rows[order] = own[np.cumsum(fresh) - 1]
            self._learn(words)
        ids, sizes = gather(self.flat, self.starts, self.sizes, rows)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        cuts = upto[np.searchsorted(begins, np.append(bases, len(codes)))]
        return [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_encoders: dict[str, CachedEncoder] = {}


def _encoder(path: str) -> CachedEncoder:
    """A worker's encoder, kept from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


def encode_chunks(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, width: int) -> DataFrame:
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        entry = pa.struct([("digest", pa.binary()), ("n_ids", pa.int32()), ("ids", pa.binary())])
        for batch in slices(batches, 300):
            counts, rows = [], []
            for ids in encoder.encode_batch(batch.column(1).to_pylist()):
                ids = np.append(ids, np.uint32(end_id))
                data, at, mine = ids.astype(kind).tobytes(), 0, []
                for end in cut(ids):
                    piece = data[at * width : end * width]
                    mine.append({"digest": hashlib.sha256(piece).digest(), "n_ids": end - at, "ids": piece})
                    at = end
                counts.append(len(ids))
                rows.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(entry))], names=["doc_id", "n_tokens", "chunks"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, _ENCODED)


@F.pandas_udf(T.BinaryType())
def _root(digests: pd.Series) -> pd.Series:
    return digests.map(lambda own: merkle([bytes(d) for d in own]))


def write_store(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> str:
    """Encode ``df`` and write the store to ``path``, which is returned."""
    from tokenizers import Tokenizer

    spark = df.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    encoded, held = durable(encode_chunks(df, tokenizer_path, end_id, id_col, text_col, width), "encoded")

    # One row a chunk; copies within a task are merged before the shuffle.
    chunks = encoded.select(F.explode("chunks").alias("c")).select("c.digest", "c.n_ids", "c.ids")
    chunks.groupBy("digest").agg(F.first("n_ids").alias("n_ids"), F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    lean = encoded.select("doc_id", "n_tokens", F.col("chunks.digest").alias("chunks"))
    ranged = lean.withColumn("tie", F.xxhash64("chunks")).repartitionByRange(shuffle_width(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered, order_path = durable(ranged.withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()), "ordered")
    drop_path(spark, held)
    own = Window.partitionBy("part").orderBy("n")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range partition; their sums in order
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("tokens"), F.coalesce(F.sum("docs").over(ahead), F.lit(0)).alias("docs"))
    # a row for each shuffle partition; wider shuffles than this leave the join to the optimizer
    parts = F.broadcast(parts) if shuffle_width(spark) <= MOST_PARTS else parts
    placed = ordered.join(parts, "part").select(
        (F.col("docs") + F.row_number().over(own) - 1).alias("place"), "doc_id", (F.col("tokens") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("start"), "n_tokens", "chunks", _root("chunks").alias("root")
    )
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    recipes = spark.read.parquet(f"{path}/recipes")
    _segments(recipes, segment).write.parquet(f"{path}/manifests")
    spark.createDataFrame([(width, end_id, segment)], "width int, end_id int, segment int").coalesce(1).write.parquet(f"{path}/_about")
    drop_path(spark, order_path)
    return path


def _segments(recipes: DataFrame, segment: int) -> DataFrame:
    """Manifests: the roots of ``segment`` recipes are a bounded group."""
    by = recipes.groupBy(F.floor(F.col("place") / segment).alias("segment")).agg(
        F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("place", "root"))).alias("roots")
    )
    return by.withColumn("root", _root("roots.root")).drop("roots")


def _about(spark: SparkSession, path: str) -> tuple[int, int, int]:
    return tuple(spark.read.parquet(f"{path}/_about").first())


def checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``digest, n_ids, crc`` (CRC-32 of the ids as unsigned 32-bit) of every chunk read and checked; raises where the bytes do not fit the digest."""
    kind = {2: "<u2", 4: "<u4"}[_about(spark, path)[0]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            crc = []
            for digest, n, data in zip(pdf["digest"], pdf["n_ids"], pdf["ids"], strict=True):
                ids = np.frombuffer(data, kind)
                if hashlib.sha256(data).digest() != bytes(digest) or len(ids) != n:
                    raise ValueError(f"chunk {bytes(digest).hex()} does not fit its digest")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pd.DataFrame({"digest": pdf["digest"], "n_ids": pdf["n_ids"], "crc": crc})

    return spark.read.parquet(f"{path}/chunks").mapInPandas(run, "digest binary, n_ids int, crc long")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of CRC-32 polynomials (bit-reversed), element by element."""
    out, b = np.zeros(len(a), dtype=np.uint64), b.astype(np.uint64)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))
    return out


def crc_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part with this CRC-32 adds (by exclusive or) to that of a whole with ``after`` more bytes behind it."""
    out, n, square = crc.astype(np.uint64), after.astype(np.uint64), np.array([1 << 23], dtype=np.uint64)  # x^8: one byte
    while n.any():
        rows = np.flatnonzero(n & np.uint64(1))
        out[rows] = _times(out[rows], np.repeat(square, len(rows)))
        square = _times(square, square)
        n = n >> np.uint64(1)
    return out


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the bytes of its chunks; raises where anything does not verify."""
    recipes = spark.read.parquet(f"{path}/recipes")
    segment = _about(spark, path)[2]
    wrong = _segments(recipes.withColumn("root", _root("chunks")), segment).select("segment", F.col("root").alias("again")).join(spark.read.parquet(f"{path}/manifests"), "segment", "full").where("root is null or again is null or root <> again")
    if not wrong.isEmpty():
        raise ValueError("a manifest does not fit its recipes")
    facts = checked_chunks(spark, path)
    each = recipes.select("place", "doc_id", "start", "n_tokens", F.size("chunks").alias("of"), F.posexplode("chunks").alias("pos", "digest"))
    behind = Window.partitionBy("place").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    met = each.join(facts, "digest", "left").withColumn("after", F.coalesce(F.sum("n_ids").over(behind), F.lit(0)) * 4)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf["crc"].isna().any():
                raise ValueError("a recipe names a chunk that is not there")
            yield pdf.assign(crc=crc_shift(pdf["crc"].to_numpy().astype(np.uint64), pdf["after"].to_numpy()).astype(np.int64))[["place", "doc_id", "start", "n_tokens", "n_ids", "crc"]]

    parts = met.select("place", "doc_id", "start", "n_tokens", "n_ids", "crc", "after").mapInPandas(run, "place long, doc_id long, start long, n_tokens long, n_ids int, crc long")
    whole = parts.groupBy("place", "doc_id", "start", "n_tokens").agg(F.expr("bit_xor(crc)").alias("ids_crc32"), F.sum("n_ids").alias("found"))
    checked = F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a recipe does not have as many ids as it says")))
    return whole.select("doc_id", "start", "n_tokens", checked.alias("ids_crc32"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` (array of int) of every document, put together from its chunks."""
    kind = {2: "<u2", 4: "<u4"}[_about(spark, path)[0]]

    @F.pandas_udf("array<int>")
    def whole(parts: pd.Series) -> pd.Series:
        return parts.map(lambda ps: np.frombuffer(b"".join(p["ids"] for p in ps), kind).astype(np.int32))

    each = spark.read.parquet(f"{path}/recipes").select("place", "doc_id", "start", F.posexplode("chunks").alias("pos", "digest"))
    met = each.join(spark.read.parquet(f"{path}/chunks"), "digest").groupBy("place", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("c"))
    return met.select("doc_id", "start", whole("c").alias("ids"))


def store_path(spark: SparkSession) -> str:
    """A fresh folder for a store in the shared folder."""
    return new_path(spark, "tokens")
