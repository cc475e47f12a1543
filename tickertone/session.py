"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Local-time buckets convert from UTC, so the session must read and write UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Title lookups give up to so many hashes to the scan; beyond this number only their range reaches it.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # Python scorers see small request batches; text columns never cross to Python whole.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


_MB = 1024 * 1024


def settings_for(shuffle_bytes: int) -> dict[str, str]:
    """Shuffle width for a job whose widest shuffle moves ``shuffle_bytes``.

    AQE joins partitions that turn out small but cannot add any, so the start is about 128 MB each.
    """
    width = max(shuffle_bytes // (128 * _MB), 200)
    return {
        "spark.sql.shuffle.partitions": str(width),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * _MB),
        "spark.sql.files.maxPartitionBytes": str(256 * _MB),
    }


def build_session(app_name: str = "tickertone", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Put a session made elsewhere on UTC, the only setting that changes results."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_placement(spark: SparkSession) -> SparkSession:
    """Let a join on several columns use rows that lie by one of them.

    What is sent ``near`` wide rows finds them only so; otherwise the join spreads both sides anew by all
    its columns, with the same result.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark
