"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where none is set
and everything runs in one process (tests, notebooks) is a folder of our own
made; the session's settings are never changed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: How intermediate tables are written.  On a local file system Hadoop puts a
#: checksum file beside each file and starts a process to set the mode of both;
#: Parquet pages have checksums of their own, so the plain file is enough.
#: Other stores do not look at the latter two.
WRITING = {"compression": "zstd", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master without one, a private folder of this application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="lexiloom-"))


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    where, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(where)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop_path(spark, path)
    return fs.exists(where)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's file scans name it."""
    where, fs = _hadoop_path(spark, path)
    return fs.makeQualified(where).toString()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file: written beside its place, then moved there."""
    where, fs = _hadoop_path(spark, path)
    beside, _ = _hadoop_path(spark, f"{where.getParent().toString()}/_{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    where, fs = _hadoop_path(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`durable` that nothing reads any more."""
    where, fs = _hadoop_path(spark, path)
    fs.delete(where, True)


#: Narrow rows that one task writes where their number is known.
ROWS_A_TASK = 250_000


def durable(df: DataFrame, label: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` once and return the frame that reads it, with its path.

    Lineage ends there, so a lost executor costs only its tasks.  ``rows``
    bounds the number of (narrow) rows: a small table is then written by a few
    tasks, not one for each shuffle partition.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_TASK)))
    df.write.options(**WRITING).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with a tail that keeps them apart from ``columns`` in any case of letters."""
    taken, tail = {c.lower() for c in columns}, ""
    while any(f"{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"{n}{tail}" for n in names]
