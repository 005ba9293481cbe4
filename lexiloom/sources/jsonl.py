"""Strict JSON-lines sources and atomic, counted sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import exists


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line: byte-order marks and blank lines are skipped, anything else that is no object raises."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    bad = "__corrupt"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    line = F.regexp_replace(F.col("value"), "^\ufeff", "")
    rows = spark.read.text(path).select(line.alias("line")).where(F.trim(line) != "")
    parsed = F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = rows.withColumn("row", parsed)
    whole = F.ltrim("line").startswith("{") & F.col("row").isNotNull() & F.col(f"row.{bad}").isNull()
    # the check is part of the value, so no optimiser can prune it away
    checked = F.when(whole, F.col("row")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("line", 1, 200))))
    return rows.select(checked.alias("row")).select(*(F.col(f"row.`{f.name}`") for f in schema.fields))


def read_fast(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Spark's own JSON scan (column pruning in the parser); scalars raise, a line with an array becomes rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> int:
    """Write with keys in order; rows are counted in the same job.  The commit protocol makes it atomic."""
    counted = Observation()
    names = sorted(df.columns)
    out = df.select(*(F.col(f"`{c}`") for c in names)).observe(counted, F.count("*").alias("rows"))
    writer = out.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
    return counted.get["rows"]


def append_pending(tasks: DataFrame, path: str, key: str, run) -> int:
    """Resumable sink: ``run(pending)`` is appended for the tasks whose key is not there yet; how many were."""
    spark = tasks.sparkSession
    if not exists(spark, path):
        return write(run(tasks), path, mode="append")
    done = spark.read.schema(T.StructType([tasks.schema[key]])).json(path)
    left = tasks.join(done.distinct(), key, "left_anti")
    return 0 if left.isEmpty() else write(run(left), path, mode="append")
