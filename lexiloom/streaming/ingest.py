"""Streaming ingest of a growing folder: normalise, judge, and keep first occurrences (beyond batch parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import quality
from ..functions import text as T
from ..functions.hashing import sha256_hex


def _accepted(df: DataFrame, entities: bool) -> DataFrame:
    text = T.normalize_text(F.col("text"), entities)
    rows = quality.accepted(df.withColumn("text", text))
    return rows.withColumn("content_hash", sha256_hex(T.dedup_key(F.col("text"))))


def start(spark: SparkSession, source: str, schema, table: str, checkpoint: str, entities: bool = True, once: bool = True, seen: str | None = None, files: int | None = None) -> StreamingQuery:
    """Append accepted, unseen documents of each micro-batch to the Parquet folder ``table``.

    What was seen is the state of the stream, one key for each content hash: a
    batch asks the state store for its own hashes and no others.  With the
    RocksDB provider (:data:`session.DEFAULTS`) the state lies on the executors'
    disks and its changes in the checkpoint, so it may grow beyond memory.  A
    batch is written under its own number and overwritten when it is retried, so
    a restart neither loses nor repeats rows.  ``seen`` (beside the table if not
    given) lists the hashes of what was written, a folder a batch; nothing here
    reads it.  ``files``: most files a batch.
    """
    seen = seen or f"{table.rstrip('/')}-seen"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        spark.read.parquet(f"{table}/batch={number}").select("content_hash").write.mode("overwrite").parquet(f"{seen}/batch={number}")

    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    query = _accepted(rows, entities).dropDuplicates(["content_hash"]).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def windowed_counts(events: DataFrame, time: str, group: str, value: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Watermarked tumbling counts and sums; the same plan runs in batch."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
