"""Feed selection, the newest-N sample and its normalised form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tickertone.functions.sentiment import in_feed
from tickertone.schemas import INTERNATIONAL, SAMPLE_SIZE, SCORED

SAMPLE_FIELDS = ("title", "link", "source", "region", "sentiment", "sentiment_score", "text", "published_at")
_TEXT_FIELDS = ("title", "link", "source", "sentiment", "text")


def feed_rows(df: DataFrame, feed: str) -> DataFrame:
    """Rows of one feed. On a store read, the feed partition is pruned as well."""
    rows = df.where(in_feed(F.col("region"), feed))
    return rows.where(F.col("feed") == feed) if "feed" in df.columns else rows


def published_since(df: DataFrame, bound) -> DataFrame:
    """Rows published at or after ``bound``. On a store read, older day partitions are pruned."""
    bound = bound if hasattr(bound, "cast") else F.lit(bound)
    rows = df.where(F.col("published_at") >= bound)
    return rows.where(F.col("published_date") >= F.to_date(bound)) if "published_date" in df.columns else rows


def newest_bound(rows: DataFrame, size: int):
    """A publish time at or before that of the ``size``-th newest row, None if fewer have one.

    Counts per publish minute need one column and shrink before the shuffle; the newest ``size``
    minutes are enough, since each holds a row.
    """
    per_minute = (
        rows.where(F.col("published_at").isNotNull())
        .groupBy(F.date_trunc("minute", "published_at").alias("minute"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("minute"))
        .limit(size)
    )
    newer = Window.orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    needed = F.coalesce(F.sum("n").over(newer), F.lit(0)) < size  # at most ``size`` rows here
    bound = per_minute.withColumn("needed", needed).where("needed").agg(
        F.when(F.sum("n") >= size, F.min("minute")).alias("bound")
    )
    return bound.first()["bound"]


def newest(df: DataFrame, feed: str, size: int = SAMPLE_SIZE, fields: tuple[str, ...] = SAMPLE_FIELDS) -> DataFrame:
    """The newest rows of a feed: publish time descending, nulls last, later arrivals first.

    A sort with limit keeps ``size`` wide rows per task and merges them in one place, which grows
    with the number of tasks. So the oldest minute that matters is found first from one narrow
    column; the wide scan then skips files, row groups and days before it.
    """
    rows = feed_rows(df, feed)
    bound = newest_bound(rows, size)
    if bound is not None:
        rows = published_since(rows, bound)
    return (
        rows.select("seq", *fields)
        .orderBy(F.col("published_at").desc_nulls_last(), F.col("seq").desc())
        .limit(size)
    )


def normalise(df: DataFrame) -> DataFrame:
    """Fill absent columns and nulls the way readers expect: text empty, region international.

    Scores and publish times that cannot be read become null.
    """
    wanted = T.StructType([f for f in SCORED.fields if f.name in SAMPLE_FIELDS])
    for field in wanted.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast("string"))
    region = F.coalesce(F.nullif(F.col("region"), F.lit("")), F.lit(INTERNATIONAL))
    return df.withColumns(
        {
            **{name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in _TEXT_FIELDS},
            "region": region,
            "sentiment_score": F.col("sentiment_score").try_cast("double"),
            "published_at": F.col("published_at").try_cast("timestamp"),
        }
    )
