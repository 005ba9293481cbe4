"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are packed in blocks.  Each block is split into pre-tokens; their
positions are kept as numbers into the block's list of distinct pre-tokens.
The lists are dealt out by a hash of the word, packed, one blob for each block
and word range; the owner of a range encodes each of its distinct words once
and joins the ids back to the blobs in their order; each document's ids are
then put together by position.  A frequent word costs a block one entry, so it
makes no hot key.

Blocks send to ``FAN`` coarse ranges at most.  Where finer ones are wanted, a
team of blocks first merges what it has for a coarse range into distinct words,
parts those into fine ranges, and hands the answers on: blobs keep some
``BLOB_WORDS`` words then, whatever the size of the input.  Blocks lie in files
of ``BLOCKS_A_FILE``, in ``MOST_BUCKETS`` buckets at most.

Decoding joins the token-byte table to the ids: the table, a fixed vocabulary
of some fifty thousand rows, refused beyond ``MAX_TOKENS``, is broadcast once,
and a document's ids gather their bytes from it in their order.

Defined cases: a null text counts as empty and has no ids; text that looks
like a special token is ordinary text; ids repeat as rows do; rows with a null
id are kept with it; a text of any length is one document of its block; other
columns are not looked at.  Ids out of the table raise when decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import expand, squeeze
from .exchange import Ranges
from .pretokens import PATTERN, code_points, gather, read_ranks, span_hashes, split_points
from .storage import durable, durable_by, once_a_worker, shuffle_width, slices

#: Characters of text after which a block is closed.
BLOCK_BYTES = 4 << 20
#: Characters that are split together.
GROUP = 1 << 19
#: Largest token table that is sent to every worker.
MAX_TOKENS = 2_000_000

#: A block is a row of its documents (owner -1) and a row for each word range: no row is large.
_BLOCKS = "home long, block long, owner int, ids binary, no_id binary, positions binary, owners binary, sizes binary, bytes binary"
_CODED = "home long, block long, owner long, answer binary"
#: Coarse ranges; words of a blob between the levels, and distinct words of a block, about.
FAN, BLOB_WORDS, BLOCK_WORDS = 4096, 32, 30_000
#: Blocks that are written and put together by one task in a row, and the buckets of their table (Spark takes 100,000).
BLOCKS_A_FILE, MOST_BUCKETS = 4, 50_000
_IDS = "doc_id long, ids binary"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, packed byte plane by byte plane."""
    return squeeze(np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view(np.int32) if len(raw) else np.zeros(0, np.int32)


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of equal hash pairs, where each number first stands, and how often."""
    order = np.lexsort((b, a))
    fresh = np.append(True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])) if len(order) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    numbers = np.empty(len(order), dtype=np.int32)
    numbers[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return numbers, order[heads], np.diff(np.append(heads, len(order)))


def _words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Pre-tokens of each text (a count), all of them as numbers, and the words by number: frequent ones first, as small numbers pack well.

    Texts are split a group at a time, and only a group's distinct words go on.
    """
    counts, numbers, found, words, lo, held = [], [], [], [], 0, 0
    for hi, text in enumerate(texts, 1):
        held += len(text or "") + 1
        if held < GROUP and hi < len(texts):
            continue
        codes, bases = code_points(texts[lo:hi])
        begins, ends = split_points(codes)
        own = np.searchsorted(bases, begins, side="right") - 1
        counts.append(np.bincount(own, minlength=hi - lo))
        a, b = span_hashes(codes, begins, ends)
        number, first, many = _numbered(a, b)
        numbers.append(number)
        found.append((a[first], b[first], many))
        at, i, j = own[first], begins[first], ends[first]
        words += [texts[lo + t][p:q].encode() for t, p, q in zip(at.tolist(), (i - bases[at]).tolist(), (j - bases[at]).tolist(), strict=True)]
        lo, held = hi, 0
    a, b, many = (np.concatenate(x) for x in zip(*found, strict=True))
    number, first, _ = _numbered(a, b)
    often = np.argsort(-np.bincount(number, weights=many, minlength=len(first)), kind="stable")
    rank = np.empty(len(first), dtype=np.int32)
    rank[often] = np.arange(len(first), dtype=np.int32)
    at, ranked = 0, rank[number]
    for k, own in enumerate(numbers):
        size = len(found[k][0])
        numbers[k] = ranked[at : at + size][own]
        at += size
    return np.concatenate(counts), np.concatenate(numbers), [words[i] for i in first[often].tolist()]


def _split(block_bytes: int, ranges: int):
    def block(number: int, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        sizes, numbers, words = _words_of(texts)
        owner = np.fromiter((zlib.crc32(w) % ranges for w in words), np.int32, len(words))
        dealt = np.argsort(owner, kind="stable")  # an owner gets its words in order of frequency
        cuts = np.flatnonzero(np.append(True, np.diff(owner[dealt]) != 0)).tolist() if len(dealt) else []
        home = number // BLOCKS_A_FILE
        rows = [(home, number, -1, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids], bool).tobytes(), _planes(numbers), _planes(owner), sizes.astype(np.int64).tobytes(), None)]
        for lo, hi in zip(cuts, [*cuts[1:], len(dealt)], strict=True):
            mine = [words[i] for i in dealt[lo:hi].tolist()]
            rows.append((home, number, int(owner[dealt[lo]]), None, None, None, None, *_packed_words(mine)))
        kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        texts: list[str | None] = []
        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                held += len(text or "") + 32
                if held >= block_bytes:
                    yield block((part << 32) | made, ids, texts)
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield block((part << 32) | made, ids, texts)

    return run


_coders: dict = {}


def _coder(ranks_path: str):
    """A worker's encoder of pre-tokens, kept from task to task; a pre-token splits into itself alone."""
    if ranks_path not in _coders:
        import tiktoken

        _coders.clear()
        _coders[ranks_path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
    return _coders[ranks_path]


def _words_in(sizes: bytes, data: bytes) -> list[bytes]:
    raw, ends = expand(data), np.cumsum(np.frombuffer(expand(sizes), np.int32))
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _packed_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return squeeze(np.fromiter(map(len, words), np.int32, len(words)).tobytes()), squeeze(b"".join(words))


def _packed_ids(ids: list) -> bytes:
    """Each word's count, and all ids in a row."""
    widths = _planes(np.fromiter(map(len, ids), np.int32, len(ids)))
    return len(widths).to_bytes(4, "little") + widths + _planes(np.array([i for x in ids for i in x], dtype=np.int32))


def _unpacked_ids(answer: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(answer[:4], "little") + 4
    return _unplanes(answer[4:n]), _unplanes(answer[n:])


def _encode_words(ranks_path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code = _coder(ranks_path)
        known: dict[bytes, list[int]] = {}
        out = []
        for sizes, data in zip(pdf["sizes"], pdf["bytes"], strict=True):
            words = _words_in(sizes, data)
            for w in words:
                if w not in known:
                    known[w] = code(w.decode())
            out.append(_packed_ids([known[w] for w in words]))
        return pd.DataFrame({"home": pdf["home"], "block": pdf["block"], "owner": pdf["owner"], "answer": out})

    return run


_WORDS = "home long, block long, owner long, sizes binary, bytes binary"


def _merged(ranges: Ranges):
    """The distinct words of a team for one coarse range, a blob for each fine range (``block`` is the team's meeting)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words = sorted({w for sizes, data in zip(pdf["sizes"], pdf["bytes"], strict=True) for w in _words_in(sizes, data)})
        fine: dict[int, list[bytes]] = {}
        for w in words:
            fine.setdefault(zlib.crc32(w) // ranges.coarse % ranges.sub, []).append(w)
        coarse, meeting = int(pdf["owner"].iloc[0]), int(key[0])
        return pd.DataFrame([(0, meeting, coarse * ranges.sub + f, *_packed_words(own)) for f, own in sorted(fine.items())], columns=["home", "block", "owner", "sizes", "bytes"])

    return run


def _parted(ranges: Ranges):
    """Answers for each blob of a team, from those for its fine ranges."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"home": [], "block": [], "owner": [], "answer": []})
        words = sorted({w for sizes, data in zip(left["sizes"], left["bytes"], strict=True) for w in _words_in(sizes, data)})
        fine: dict[int, list[bytes]] = {}
        for w in words:
            fine.setdefault(zlib.crc32(w) // ranges.coarse % ranges.sub, []).append(w)
        answers, known = dict(zip(right["owner"] % ranges.sub, right["answer"], strict=True)), {}
        for f, own in fine.items():
            widths, flat = _unpacked_ids(answers[f])
            ends = np.cumsum(widths).tolist()
            known.update({w: flat[a:b] for w, a, b in zip(own, [0, *ends[:-1]], ends, strict=True)})
        out = [_packed_ids([known[w] for w in _words_in(sizes, data)]) for sizes, data in zip(left["sizes"], left["bytes"], strict=True)]
        return pd.DataFrame({"home": left["home"], "block": left["block"], "owner": left["owner"], "answer": out})

    return run


def _coded(words: DataFrame, ranks_path: str, ranges: Ranges) -> DataFrame:
    """Answers (:data:`_CODED`) for all blobs of words, each distinct word encoded once."""
    if ranges.sub == 1:
        return words.groupBy("owner").applyInPandas(_encode_words(ranks_path), _CODED)
    meeting = F.col("owner") * ranges.teams + F.pmod(F.xxhash64("block"), F.lit(ranges.teams))
    sent, _ = durable(words.withColumn("meeting", meeting), "words")
    fine = sent.groupBy("meeting").applyInPandas(_merged(ranges), _WORDS).groupBy("owner").applyInPandas(_encode_words(ranks_path), _CODED)
    return sent.groupBy("meeting").cogroup(fine.groupBy("block")).applyInPandas(_parted(ranges), _CODED)


def _ranges_for(spark: SparkSession, size: int, block_bytes: int) -> Ranges:
    """Word ranges for so many bytes of text, and the teams between two levels of them."""
    wanted = max(shuffle_width(spark), -(-size // RANGE_BYTES))
    if wanted <= FAN:
        return Ranges(wanted)
    sub, blocks = -(-wanted // FAN), max(1, size // block_bytes)
    team = max(1, sub * BLOB_WORDS * FAN // BLOCK_WORDS)  # blocks with BLOB_WORDS words for each fine range
    return Ranges(FAN, sub, max(1, -(-blocks // team)))


def _assemble(table):
    """``table``: the broadcast token-byte table where the ids are decoded as well."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        decoder = table and once_a_worker(table, _Decoder)
        answers: dict[int, list] = {}
        for block, owner, answer in sorted(zip(right["block"], right["owner"], right["answer"], strict=True), key=itemgetter(0, 1)):
            answers.setdefault(block, []).append(answer)
        out_ids, out, decoded = [], [], []
        for row in left.itertuples(index=False):
            ids, no_id = np.frombuffer(row.ids, np.int64), np.frombuffer(row.no_id, bool)
            sizes, at, owners = np.frombuffer(row.sizes, np.int64), _unplanes(row.positions), _unplanes(row.owners)
            widths, flats = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for answer in answers.get(row.block, ()):
                width, flat = _unpacked_ids(answer)
                widths.append(width)
                flats.append(flat)
            width, flat = np.concatenate(widths).astype(np.int64), np.concatenate(flats).astype("<u4")
            starts = np.cumsum(width) - width
            place = np.empty(len(owners), dtype=np.int64)
            place[np.argsort(owners, kind="stable")] = np.arange(len(owners))
            at, doc_ends = place[at], np.cumsum(sizes)
            for i, (end, size) in enumerate(zip(doc_ends.tolist(), sizes.tolist(), strict=True)):
                out_ids.append(None if no_id[i] else int(ids[i]))
                out.append(gather(flat, starts, width, at[end - size : end])[0].tobytes())
                if decoder:
                    decoded.append(decoder(out[-1]))
        return pd.DataFrame({"doc_id": pd.array(out_ids, "Int64"), "ids": out} | ({"decoded": decoded} if table else {}))

    return run


#: Bytes of text for each word range at least (about a hundred thousand distinct words of the owner).
RANGE_BYTES = 8 << 20


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, ids`` (little-endian unsigned 32-bit).

    With ``decoded`` the ids of a block are joined with the token-byte table
    in the task that put them together, as :func:`decode` does, and
    ``decoded`` (bytes) is added.
    """
    spark = df.sparkSession
    two = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = two.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = _ranges_for(spark, size, block_bytes)
    blocks = durable_by(two.mapInArrow(_split(block_bytes, ranges.coarse), _BLOCKS), "home", min(MOST_BUCKETS, max(shuffle_width(spark), -(-size // RANGE_BYTES))), "pretokens")
    coded = _coded(blocks.where("owner >= 0").select("home", "block", F.col("owner").cast("long").alias("owner"), "sizes", "bytes"), ranks_path, ranges)
    table = spark.sparkContext.broadcast(token_table(ranks_path)) if decoded else None  # at most MAX_TOKENS tokens
    own = blocks.where("owner < 0").select("home", "block", "ids", "no_id", "sizes", "positions", "owners")
    return own.groupBy("home").cogroup(coded.groupBy("home")).applyInPandas(_assemble(table), _IDS + ", decoded binary" * decoded)


def token_table(ranks_path: str) -> tuple[bytes, np.ndarray]:
    """The bytes of all tokens in a row, and how many each id has (-1: no such id)."""
    ranks = read_ranks(ranks_path)
    top = max(ranks.values(), default=-1) + 1
    if top > MAX_TOKENS:
        raise ValueError(f"{top} tokens; at most {MAX_TOKENS} are sent to every worker")
    sizes = np.full(top, -1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return b"".join(token for token, _ in sorted(ranks.items(), key=lambda x: x[1])), sizes


class _Decoder:
    def __init__(self, table: tuple[bytes, np.ndarray]):
        self.bytes, self.sizes = np.frombuffer(table[0], np.uint8), table[1]
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)

    def __call__(self, ids: bytes) -> bytes:
        """The bytes of a document's ids."""
        own = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(own) and (int(own.max()) >= len(self.sizes) or int(self.sizes[own].min()) < 0):
            raise ValueError("an id is not in the token table")
        return gather(self.bytes, self.starts, self.sizes, own)[0].tobytes()


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, ids, decoded`` (bytes; null ids stay null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_table(ranks_path))  # at most MAX_TOKENS tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = once_a_worker(shared, _Decoder)
        for batch in slices(batches):
            decoded = [None if x is None else decoder(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
