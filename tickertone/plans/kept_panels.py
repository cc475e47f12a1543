"""The panels over kept tables: ``(counts or newest, as_of) -> DataFrame``.

They give what the panels over the store give at ``as_of`` in whole minutes, from tables whose size
does not depend on the store's.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from tickertone.operators import grids
from tickertone.operators.samples import normalise
from tickertone.plans import panels
from tickertone.schemas import SAMPLE_SIZE
from tickertone.sources.kept import INGESTED, PUBLISHED, TOTAL, KeptCounts, KeptNewest


def whole_minute(as_of: datetime) -> datetime:
    return as_of.replace(second=0, microsecond=0)


def _since(rows: DataFrame, bound: datetime) -> DataFrame:
    """Minutes at or after a bound; older days are not read."""
    return rows.where((F.col("minute") >= F.lit(bound)) & (F.col("day") >= F.to_date(F.lit(bound))))


def _by_feed(rows: DataFrame, *measures) -> DataFrame:
    feeds = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, panels.FEEDS))).alias("feed"))
    return feeds.join(rows.where(F.col("feed").isin(*panels.FEEDS)).groupBy("feed").agg(*measures), "feed", "left")


def _zero(name: str):
    return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)


def region_counts(counts: KeptCounts) -> DataFrame:
    """Records of each feed and of the whole store."""
    return panels.region_counts(counts.read(TOTAL).withColumnRenamed("feed", "region"), F.sum("stories"))


def ingest_rate(counts: KeptCounts, as_of: datetime) -> DataFrame:
    """Records taken in since the minute an hour before, and per minute of it."""
    recent = _since(counts.read(INGESTED), whole_minute(as_of) - timedelta(hours=1))
    rates = _by_feed(recent, F.sum("stories").alias("recent")).select("feed", _zero("recent"))
    return rates.withColumn("per_minute", F.col("recent") / 60.0)


def rolling_sentiment(counts: KeptCounts, as_of: datetime) -> DataFrame:
    """Mean score and count by publish time over 24 hours and the last 60 minutes."""
    end = whole_minute(as_of)
    day = _since(counts.read(PUBLISHED), end - timedelta(hours=24)).where(F.col("minute") < F.lit(end))
    last_hour = F.col("minute") >= F.lit(end - timedelta(minutes=60))
    sums = _by_feed(
        day,
        F.sum("score_sum").alias("sum_24h"),
        F.sum("scored").alias("count_24h"),
        F.sum(F.when(last_hour, F.col("score_sum"))).alias("sum_60m"),
        F.sum(F.when(last_hour, F.col("scored"))).alias("count_60m"),
    )
    return sums.select(
        "feed",
        F.try_divide("sum_24h", "count_24h").alias("avg_24h"),
        _zero("count_24h"),
        F.try_divide("sum_60m", "count_60m").alias("avg_60m"),
        _zero("count_60m"),
    )


def sentiment_grid(counts: KeptCounts, as_of: datetime, spec: tuple[str, int, str] = grids.HOURLY) -> DataFrame:
    """Stories of the whole store per local bucket and label."""
    minutes = counts.read(PUBLISHED).select("sentiment", "stories", F.col("minute").alias("published_at"), F.col("day").alias("published_date"))
    return grids.sentiment_grid(minutes, as_of, spec, count=F.sum("stories"))


def newest(kept: KeptNewest, feed: str, size: int = SAMPLE_SIZE) -> DataFrame:
    """The newest articles of a feed in their order."""
    rows = kept.read().where(F.col("feed") == feed).drop("feed")
    return rows.orderBy(F.col("published_at").desc_nulls_last(), F.col("seq").desc()).limit(size)


def sample(kept: KeptNewest, feed: str, size: int = SAMPLE_SIZE) -> DataFrame:
    return normalise(newest(kept, feed, size))


def overview(counts: KeptCounts, kept: KeptNewest, as_of: datetime, size: int = SAMPLE_SIZE) -> DataFrame:
    """All headline numbers, one row per feed."""
    shares = [panels.coverage(sample(kept, feed, size)).withColumn("feed", F.lit(feed)) for feed in panels.FEEDS]
    numbers = region_counts(counts).join(ingest_rate(counts, as_of), "feed").join(rolling_sentiment(counts, as_of), "feed")
    return numbers.join(shares[0].unionByName(shares[1]), "feed")
