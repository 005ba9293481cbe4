"""A sink that keeps what every finished task wrote, for runs that may be cut short.

Spark's own sinks publish at the end of a job.  Format ``lexiloom_journal``
publishes at the end of each task: its rows go to a hidden file, which is then
moved to a name made from the task's keys.  A task that runs twice over the same
keys makes the same name, so its second try leaves the file that is there.  The
driver commits nothing, and a job that fails takes nothing back.

:func:`run_pending` asks for what is not there yet and deals it to tasks of about
``rows`` rows; :func:`committed` reads one row a key, that of the first file by
name, should two runs have overlapped.

Options: ``path`` (a folder that all executors share, in a file system that Arrow
knows), ``key`` (a column).

Defined cases: a task without rows writes nothing; a null key is a key of its own
and is asked for only once; rows of one task that repeat a key are all written
and one of them, the least, is read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .jsonsource import file_system
from .shared import drop_path, durable, exists, unused

FORMAT = "lexiloom_journal"
#: Rows of a task, and so of a commit.
ROWS = 256


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.key = options["path"].rstrip("/"), options["key"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        batches = [b for b in iterator if b.num_rows]  # a task's rows are few
        if batches:
            table = pa.Table.from_batches(batches)
            fs, folder = file_system(self.path)
            name = self._name(table[self.key].to_pylist())
            if fs.get_file_info(f"{folder}/{name}").type == pa.fs.FileType.NotFound:
                fs.create_dir(folder, recursive=True)
                hidden = f"{folder}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden) as out:
                    pa.parquet.write_table(table, out, compression="zstd")
                fs.move(hidden, f"{folder}/{name}")
        return WriterCommitMessage()

    def _name(self, keys: list) -> str:
        digest = hashlib.sha256()
        for k in sorted("" if k is None else f"={k}" for k in keys):
            digest.update(f"{len(k)}:{k}".encode())
        return f"part-{digest.hexdigest()}.parquet"

    def commit(self, messages: list) -> None:
        """Nothing is left to publish."""

    def abort(self, messages: list) -> None:
        """What finished stays."""


class Journal(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a journal is only added to")
        return Writer(self.options)


def append(df: DataFrame, path: str, key: str) -> int:
    """Add the rows of ``df``, a commit a task; how many they were."""
    df.sparkSession.dataSource.register(Journal)
    counted = Observation()
    df.observe(counted, F.count("*").alias("rows")).write.format(FORMAT).mode("append").options(path=path, key=key).save()
    return counted.get["rows"]


def committed(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """What is in the journal, one row a key; none where there is no journal yet."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    names = [f"`{n}`" for n in schema.names]
    file, row = unused(schema.names, "file", "row")
    rows = spark.read.schema(schema).parquet(path).select(*names, F.col("_metadata.file_name").alias(file))
    one = rows.groupBy(f"`{key}`").agg(F.min_by(F.struct(*names), F.struct(F.col(file), F.to_json(F.struct(*names)))).alias(row))
    return one.select(*[F.col(f"{row}.{n}") for n in names])


def run_pending(tasks: DataFrame, path: str, key: str, run: Callable[[DataFrame], DataFrame], rows: int = ROWS) -> int:
    """Append ``run(pending)`` for the tasks whose key the journal lacks; how many rows that gave.

    ``run`` works row by row or batch by batch, so that its tasks are those
    dealt here.  If it raises, tasks that had finished stay, and the next call
    does only the rest.
    """
    spark = tasks.sparkSession
    left = tasks
    if exists(spark, path):
        done = spark.read.schema(T.StructType([tasks.schema[key]])).parquet(path).distinct()
        both = tasks.alias("tasks").join(done.alias("done"), F.col(f"tasks.`{key}`").eqNullSafe(F.col(f"done.`{key}`")), "left_anti")
        left = both.select(*[F.col(f"tasks.`{c}`") for c in tasks.columns])
    left, held = durable(left, "pending")  # a retried task gets the same keys
    try:
        n = left.count()
        return append(run(left.repartition(-(-n // rows), f"`{key}`")), path, key) if n else 0
    finally:
        drop_path(spark, held)
