"""Feed entries to article records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tickertone.functions.text import excerpt, strip
from tickertone.functions.times import feed_time
from tickertone.operators.sizes import broadcast_within
from tickertone.schemas import EXCERPT_CHARS, NO_LINK, NO_TITLE

REGISTRY_BROADCAST_ROWS = 100_000


def ingest_time(as_of: datetime | None = None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of)


def tag_entries(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Source and region of each entry's feed. The registry is broadcast once its size is checked."""
    return entries.join(broadcast_within(registry, REGISTRY_BROADCAST_ROWS), "url")


def build_articles(tagged: DataFrame, as_of: datetime | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Article records of tagged entries; entries without a title element are dropped."""
    title = strip(F.coalesce(F.col("title"), F.lit(NO_TITLE)))
    return tagged.where(title != NO_TITLE).select(
        *keep,
        title.alias("title"),
        excerpt(F.col("content"), F.col("summary"), F.col("description"), EXCERPT_CHARS).alias("text"),
        F.coalesce("link", F.lit(NO_LINK)).alias("link"),
        "source",
        "region",
        F.coalesce(feed_time(F.col("published")), feed_time(F.col("updated"))).alias("published_at"),
        ingest_time(as_of).alias("ingested_at"),
    )
