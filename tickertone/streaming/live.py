"""Analytics that keep themselves up to date."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickertone.functions.times import local_time
from tickertone.operators import grids
from tickertone.plans import kept_panels, panels
from tickertone.sources.store import ScoredStore

_BUCKETS = "bucket timestamp, sentiment string, stories bigint, day date"
# Window length and the offset that puts its edges on local hours and days (+05:45).
WINDOWS = {"hour": ("1 hour", "15 minutes"), "day": ("1 day", "18 hours 15 minutes")}


def bucket_counts(scored: DataFrame, unit: str = "hour") -> DataFrame:
    """Stories per local time bucket and label as a stream over publish time.

    There is no watermark: late news counts, and one story dated ahead does not shut the others
    out. State holds one row per bucket and label that ever had a story, some thousands a year.
    """
    length, start = WINDOWS[unit]
    window = F.window("published_at", length, length, start)
    return (
        scored.groupBy(window.alias("window"), "sentiment")
        .agg(F.count("*").alias("stories"))
        .select(local_time(F.col("window.start")).alias("bucket"), "sentiment", "stories")
    )


def start_bucket_counts(counts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep a table of all counts, one row a bucket and label, however late their stories come.

    A micro-batch gives whole new counts of the buckets that it changed. They take the place of the
    old ones in the local days that they belong to, which are rewritten as one small file each: the
    table grows with the days and never with the batches, and a batch that runs again changes nothing.
    """
    spark = counts.sparkSession
    spark.createDataFrame([], _BUCKETS).write.mode("ignore").partitionBy("day").parquet(path)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        changed = batch.withColumns({"day": F.to_date("bucket"), "_new": F.lit(True)}).persist()
        try:
            days = [row.day for row in changed.select("day").distinct().collect()]  # the days of one batch
            if not days:
                return
            kept = spark.read.schema(_BUCKETS).parquet(path).where(F.col("day").isin(days)).withColumn("_new", F.lit(False))
            latest = kept.unionByName(changed).groupBy("day", "bucket", "sentiment").agg(F.max_by("stories", "_new").alias("stories"))
            (
                latest.repartition("day")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("day")
                .parquet(path)
            )
        finally:
            changed.unpersist()

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def read_bucket_counts(spark: SparkSession, path: str) -> DataFrame:
    """The latest count of each bucket and label."""
    return spark.read.schema(_BUCKETS).parquet(path).select("bucket", "sentiment", "stories")


KEPT_VERSIONS = 5  # older panel versions are deleted; readers of the newest are not disturbed
_VERSIONS = "version string, as_of timestamp"


def write_panels(store: ScoredStore, path: str, as_of: datetime) -> str:
    """Write all panel tables at ``as_of`` (its whole minute) as a new version, then make it the current one.

    They come from the counts and newest articles that the micro-batches keep; the store is not read.
    """
    spark = store.spark
    version = f"{as_of:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    to = f"{path}/{version}"
    kept_panels.overview(store.counts, store.newest, as_of).write.parquet(f"{to}/overview")
    for feed in panels.FEEDS:
        rows = kept_panels.sample(store.newest, feed).persist()  # at most the sample size
        try:
            tables = {
                "sentiment_mix": panels.sentiment_mix(rows),
                "source_counts": panels.source_counts(rows),
                "story_list": panels.story_list(rows),
                "hourly_sentiment": grids.sentiment_grid(rows, as_of, grids.HOURLY),
                "daily_sentiment": grids.sentiment_grid(rows, as_of, grids.DAILY),
            }
            for name, table in tables.items():
                table.write.parquet(f"{to}/{feed}/{name}")
        finally:
            rows.unpersist()
    # The row that names the version appears only after all its tables are there.
    spark.createDataFrame([(version, as_of)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName() != "versions")
    for old in found[:-KEPT_VERSIONS]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return version


def current_panels(spark: SparkSession, path: str) -> str:
    """Folder of the newest complete version of the panel tables."""
    newest = spark.read.schema(_VERSIONS).parquet(f"{path}/versions").agg(F.max("version").alias("version")).first()
    return f"{path}/{newest.version}"


def start_refresh(
    spark: SparkSession, store: ScoredStore, path: str, checkpoint: str, interval: str = "10 seconds"
) -> StreamingQuery:
    """Write the panel tables anew on every tick of the clock; readers follow ``current_panels``."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def refresh(batch: DataFrame, batch_id: int) -> None:
        write_panels(store, path, datetime.now(timezone.utc))

    return (
        ticks.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )
