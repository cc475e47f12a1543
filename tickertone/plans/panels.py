"""Analytics over the scored store: ``(frame, as_of) -> DataFrame``.

Whole-store numbers answer both feeds in one scan; partial aggregation leaves at most one row per
feed and task to shuffle.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tickertone.functions import display
from tickertone.functions.sentiment import feed_of
from tickertone.functions.text import blank
from tickertone.operators.samples import feed_rows, newest, normalise, published_since
from tickertone.schemas import INTERNATIONAL, NEPALI, SAMPLE_SIZE, STORY_LIST_SIZE

FEEDS = (INTERNATIONAL, NEPALI)


def _all_feeds(df: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures of both feeds, also of one without rows."""
    feeds = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, FEEDS))).alias("feed"))
    return feeds.join(measures, "feed", "left")


def _by_feed(df: DataFrame, *measures: Column) -> DataFrame:
    shown = df.withColumn("feed", feed_of(F.col("region"))).where(F.col("feed").isin(*FEEDS))
    return _all_feeds(df, shown.groupBy("feed").agg(*measures))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)


def region_counts(df: DataFrame, count: Column | None = None) -> DataFrame:
    """Records of each feed, and of the whole store, from one scan of the region column.

    ``count`` is how rows count, each as one if not given.
    """
    records = F.count("*") if count is None else count
    per_region = df.groupBy(feed_of(F.col("region")).alias("feed")).agg(records.alias("records"))
    both = per_region.agg(
        F.sum("records").alias("all_records"),
        *[F.sum(F.when(F.col("feed") == feed, F.col("records"))).alias(feed) for feed in FEEDS],
    )
    rows = F.array(*[F.struct(F.lit(f).alias("feed"), F.col(f).alias("records")) for f in FEEDS])
    return both.select(F.explode(rows).alias("row"), "all_records").select(
        "row.feed",
        F.coalesce("row.records", F.lit(0)).cast("long").alias("records"),
        F.coalesce("all_records", F.lit(0)).cast("long").alias("all_records"),
    )


def ingest_rate(df: DataFrame, as_of: datetime) -> DataFrame:
    """Records taken in during the last hour, and per minute of it."""
    recent = df.where(F.col("ingested_at") >= F.lit(as_of - timedelta(hours=1)))
    counts = _by_feed(recent, F.count("*").alias("recent"))
    return counts.select("feed", _zero("recent")).withColumn("per_minute", F.col("recent") / 60.0)


def rolling_sentiment(df: DataFrame, as_of: datetime) -> DataFrame:
    """Mean score and count by publish time over 24 hours and the last 60 minutes, in one pass."""
    day = published_since(df, as_of - timedelta(hours=24)).where(
        (F.col("published_at") < F.lit(as_of)) & F.col("sentiment_score").isNotNull()
    )
    last_hour = F.col("published_at") >= F.lit(as_of - timedelta(minutes=60))
    score = F.col("sentiment_score")
    sums = _by_feed(
        day,
        F.avg(score).alias("avg_24h"),
        F.count("*").alias("count_24h"),
        F.sum(F.when(last_hour, score)).alias("sum_60m"),
        F.count_if(last_hour).alias("count_60m"),
    )
    return sums.select(
        "feed",
        "avg_24h",
        _zero("count_24h"),
        F.try_divide("sum_60m", "count_60m").alias("avg_60m"),
        _zero("count_60m"),
    )


def sample(df: DataFrame, feed: str, size: int = SAMPLE_SIZE) -> DataFrame:
    """The newest rows of a feed, normalised: the input of the panels below."""
    return normalise(newest(df, feed, size))


def sentiment_mix(rows: DataFrame) -> DataFrame:
    """Stories per label, most frequent first."""
    counts = rows.groupBy("sentiment").agg(F.count("*").alias("stories"))
    return counts.orderBy(F.desc("stories"), "sentiment")


def source_counts(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("source").agg(F.count("*").alias("stories"))
    return counts.orderBy(F.desc("stories"), "source")


def coverage(rows: DataFrame) -> DataFrame:
    """Sample size, share of rows with an excerpt, share with a score, mean score."""
    scored = F.col("sentiment_score").isNotNull()
    return rows.agg(
        F.count("*").alias("sample_size"),
        F.avg((~blank(F.col("text"))).cast("int")).alias("text_coverage"),
        F.avg(scored.cast("int")).alias("scoring_coverage"),
        F.avg("sentiment_score").alias("mean_score"),
    )


def story_list(rows: DataFrame, size: int = STORY_LIST_SIZE) -> DataFrame:
    """The first rows of the sample with their display fallbacks."""
    top = rows.orderBy(F.col("published_at").desc_nulls_last(), F.col("seq").desc()).limit(size)
    return top.select(
        "seq",
        display.shown_title(F.col("title")).alias("headline"),
        display.shown_source(F.col("source")).alias("source"),
        display.shown_label(F.col("sentiment")).alias("label"),
        display.label_class(F.col("sentiment")).alias("label_class"),
        display.shown_time(F.col("published_at")).alias("published"),
        display.shown_link(F.col("link")).alias("link"),
        "sentiment_score",
    )


def overview(df: DataFrame, as_of: datetime, size: int = SAMPLE_SIZE) -> DataFrame:
    """All headline numbers, one row per feed."""
    samples = [coverage(sample(df, feed, size)).withColumn("feed", F.lit(feed)) for feed in FEEDS]
    shares = samples[0].unionByName(samples[1])
    return _store_numbers(df, as_of).join(shares, "feed")


def _store_numbers(df: DataFrame, as_of: datetime) -> DataFrame:
    """Counts, rate and rolling means of both feeds in one pass over four narrow columns."""
    at, score = F.col("published_at"), F.col("sentiment_score")
    in_day = (at >= F.lit(as_of - timedelta(hours=24))) & (at < F.lit(as_of)) & score.isNotNull()
    in_hour = in_day & (at >= F.lit(as_of - timedelta(minutes=60)))
    per_feed = df.groupBy(feed_of(F.col("region")).alias("feed")).agg(
        F.count("*").alias("records"),
        F.count_if(F.col("ingested_at") >= F.lit(as_of - timedelta(hours=1))).alias("recent"),
        F.avg(F.when(in_day, score)).alias("avg_24h"),
        F.count_if(in_day).alias("count_24h"),
        F.sum(F.when(in_hour, score)).alias("sum_60m"),
        F.count_if(in_hour).alias("count_60m"),
    )
    # One row per feed, a handful; folded to one row and spread out again over the shown feeds.
    rows = per_feed.agg(F.sum("records").alias("all_records"), F.collect_list(F.struct(*per_feed.columns)).alias("rows"))
    shown = F.explode(F.array(*map(F.lit, FEEDS))).alias("feed")
    rows = rows.select("all_records", "rows", shown)
    row = F.get(F.filter("rows", lambda x: x["feed"] == F.col("feed")), F.lit(0))
    found = rows.select("feed", "all_records", row.alias("row")).select("feed", "all_records", *[F.col(f"row.{c}").alias(c) for c in per_feed.columns if c != "feed"])
    return found.select(
        "feed",
        _zero("records"),
        _zero("all_records"),
        _zero("recent"),
        (_zero("recent") / 60.0).alias("per_minute"),
        "avg_24h",
        _zero("count_24h"),
        F.try_divide("sum_60m", "count_60m").alias("avg_60m"),
        _zero("count_60m"),
    )


def metric_texts(metrics: DataFrame) -> DataFrame:
    """Text forms of the overview tiles."""
    return metrics.select(
        "feed",
        display.signed_percent(F.col("avg_60m")).alias("avg_60m"),
        display.signed_percent(F.col("avg_24h")).alias("avg_24h"),
        F.format_string("%.1f records/min over 60 min", "per_minute").alias("rate"),
        display.whole_percent(F.col("text_coverage")).alias("text_coverage"),
        display.whole_percent(F.col("scoring_coverage")).alias("scoring_coverage"),
        display.signed_percent(F.col("mean_score")).alias("mean_score"),
    )


__all__ = [
    "FEEDS", "coverage", "feed_rows", "ingest_rate", "metric_texts", "overview", "region_counts",
    "rolling_sentiment", "sample", "sentiment_mix", "source_counts", "story_list",
]
