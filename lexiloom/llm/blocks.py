"""Documents packed into compressed blocks, the unit of work of the substring operators.

A block holds about two MB of consecutive documents of one input partition: their
ids, lengths and texts (zstd).  A document is never cut.  Blocks are written
once to the shared folder, so every later pass sees the same blocks under the
same numbers, whatever executors are lost in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, slices

SCHEMA = "block long, docs int, raw_bytes long, ids binary, sizes binary, data binary"

#: Bytes of text after which a block is closed.
BLOCK_BYTES = 2 << 20


def squeeze(data) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(data))


class Block:
    """A decoded block: ``buf`` is all texts, each followed by a line feed."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = np.frombuffer(bytes(ids), dtype=np.int64)
        self.sizes = np.frombuffer(bytes(sizes), dtype=np.int64)
        self.raw = expand(data)
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        self.ends = np.cumsum(np.maximum(self.sizes, 0) + 1)
        self.starts = self.ends - np.maximum(self.sizes, 0) - 1

    def text(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i] - 1]


def _pack(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        sizes: list[int] = []
        texts: list[bytes] = []
        held = 0

        def close():
            nonlocal ids, sizes, texts, held, made
            raw = b"".join(x + b"\n" for x in texts)
            row = pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(part << 32) | made], pa.int64()), "docs": pa.array([len(ids)], pa.int32()), "raw_bytes": pa.array([len(raw)], pa.int64()),
                    "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "sizes": pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()), "data": pa.array([squeeze(raw)], pa.binary()),
                }
            )
            ids, sizes, texts, held, made = [], [], [], 0, made + 1
            return row

        for batch in slices(batches):
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                ids.append(i)
                sizes.append(-1 if x is None else len(x))
                texts.append(x or b"")
                held += len(texts[-1]) + 1
                if held >= block_bytes:
                    yield close()
        if ids:
            yield close()

    return run


def pack(df: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """Blocks of ``df`` in a durable table, with its path.  Rows with a null id are left out."""
    two = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null")
    return durable(two.mapInArrow(_pack(block_bytes), SCHEMA), "blocks")


def blocks_in(pdf: pd.DataFrame) -> Iterator[tuple[int, Block]]:
    for row in pdf.itertuples(index=False):
        yield row.block, Block(row.ids, row.sizes, row.data)
