"""Durable intermediate tables laid out by a key, and what workers keep.

Lineage is cut with Parquet tables under ``spark.checkpoint.dir``: unlike a
local checkpoint they outlive any executor, and unlike ``checkpoint()`` they
are columnar and compressed.
"""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import WRITING, drop_path, durable, new_path, unused

__all__ = ["drop_path", "durable", "durable_by", "new_path", "once_a_worker", "shuffle_width", "slices", "unused"]


def _return_freed_arrays() -> None:
    """Let freed arrays beyond four megabytes go back to the system at once.

    glibc raises the size from which it does so with every large array that is
    freed, and a worker then stays as large as the most it ever held.
    """
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None) if sys.platform == "linux" else None
    if mallopt:
        mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())


_return_freed_arrays()


def durable_by(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Like :func:`durable`, laid out by a hash of ``key``: grouping by it needs no shuffle of this table.

    The layout is known through a catalogue entry that is dropped at once; the
    returned frame keeps it, and the files stay until the driver's JVM ends.
    """
    spark = df.sparkSession
    path, name = new_path(spark, label), f"lexiloom_{uuid.uuid4().hex}"
    df.write.options(**WRITING).bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of whole texts in parts of at most ``rows`` rows and about ``size`` bytes, so that Python workers stay small."""
    for batch in batches:
        n = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_made: dict[str, tuple] = {}


def once_a_worker(shared, build):
    """``build(shared.value)``, kept by a Python worker from task to task; the last one of each builder."""
    value, name = shared.value, f"{build.__module__}.{build.__qualname__}"
    if name not in _made or _made[name][0] is not value:
        _made[name] = (value, build(value))
    return _made[name][1]
