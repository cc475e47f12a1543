"""Counts per local time bucket and label, with the empty cells filled in."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickertone.functions.display import DAY_LABEL, HOUR_LABEL
from tickertone.functions.times import local_bucket
from tickertone.operators.samples import published_since
from tickertone.schemas import LABELS, LOCAL_ZONE

# Unit, number of buckets up to the current one, and bucket label.
HOURLY = ("hour", 24, HOUR_LABEL)
DAILY = ("day", 7, DAY_LABEL)


def bucket_grid(spark: SparkSession, as_of: datetime, unit: str, periods: int, zone: str = LOCAL_ZONE) -> DataFrame:
    """Every bucket up to the current one with every label, as a generated row set."""
    last = local_bucket(F.lit(as_of), unit, zone)
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    buckets = F.sequence(last - F.expr(f"INTERVAL {periods - 1} {unit.upper()}"), last, step)
    labels = F.array(*[F.lit(name) for name in LABELS])
    return (
        spark.range(1)
        .select(F.explode(buckets).alias("bucket"))
        .select("bucket", F.explode(labels).alias("sentiment"))
    )


def sentiment_grid(
    df: DataFrame,
    as_of: datetime,
    spec: tuple[str, int, str] = HOURLY,
    zone: str = LOCAL_ZONE,
    count: Column | None = None,
) -> DataFrame:
    """Stories per bucket and label. ``df`` may be the newest-N sample or the whole store.

    ``count`` is how rows count, each as one if not given.

    Rows older than the grid are dropped before the conversion, by a bound on the raw publish
    time that a scan can use; one period is added, so the local bucket edge needs no second rule.
    """
    unit, periods, pattern = spec
    reach = timedelta(hours=periods + 1) if unit == "hour" else timedelta(days=periods + 1)
    recent = published_since(df, as_of - reach)
    counts = recent.groupBy(
        local_bucket(F.col("published_at"), unit, zone).alias("bucket"), "sentiment"
    ).agg((F.count("*") if count is None else count).alias("n"))
    grid = bucket_grid(df.sparkSession, as_of, unit, periods, zone)
    return grid.join(counts, ["bucket", "sentiment"], "left").select(
        "bucket",
        F.date_format("bucket", pattern).alias("period"),
        "sentiment",
        F.coalesce("n", F.lit(0)).cast("long").alias("stories"),
    )
