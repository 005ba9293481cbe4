"""Session defaults for scale, and facts about the environment."""

from __future__ import annotations

import platform
import sys

from pyspark.sql import SparkSession

#: Adaptive execution, UTC, and partitions that fit an executor's memory.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def build(app: str = "lexiloom", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def doctor(spark: SparkSession) -> dict:
    """Versions and settings that results depend on."""
    return {"python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "adaptive": spark.conf.get("spark.sql.adaptive.enabled"), "time_zone": spark.conf.get("spark.sql.session.timeZone")}
