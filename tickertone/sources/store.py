"""Append-only store of scored articles and what is kept beside it.

``articles/`` is partitioned by feed and publish date, so panels read recent days of one feed, and
below them by micro-batch, so that a batch that runs again overwrites what it wrote. ``titles/`` is
the index of stored titles, ``counts/`` and ``newest/`` what the panels read, ``responses/`` the
answers paid for by batches that are not done.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickertone.functions.sentiment import feed_of
from tickertone.schemas import SCORED
from tickertone.sources.kept import KeptCounts, KeptNewest
from tickertone.sources.ledger import ResponseLedger
from tickertone.sources.titles import TitleIndex

_ARTICLES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        *SCORED.fields,
        T.StructField("feed", T.StringType()),
        T.StructField("published_date", T.DateType()),
        T.StructField("batch", T.StringType()),
    ]
)


def batch_name(stream: str, number: int) -> str:
    """Name of a micro-batch; ``stream`` tells the streams that have written to a store apart."""
    return f"{stream or 'batch'}-{number:010d}"


class ScoredStore:
    """``scorer_name`` tells the answers of one scorer from those of another."""

    def __init__(self, spark: SparkSession, root: str, scorer_name: str = ""):
        self.spark, self.articles_path = spark, f"{root}/articles"
        self.titles = TitleIndex(spark, f"{root}/titles")
        self.counts, self.newest = KeptCounts(spark, f"{root}/counts"), KeptNewest(spark, f"{root}/newest")
        self.ledger = ResponseLedger(spark, f"{root}/responses", scorer_name)
        empty = spark.createDataFrame([], _ARTICLES)
        empty.write.mode("ignore").partitionBy("feed", "published_date", "batch").parquet(self.articles_path)

    def articles(self) -> DataFrame:
        return self.spark.read.schema(_ARTICLES).parquet(self.articles_path)

    def append(self, scored: DataFrame, batch: str | None = None) -> None:
        """Write the articles of a batch, in place of what an earlier try of it wrote.

        The rebalance splits a hot day over tasks and joins small ones.
        """
        laid_out = scored.select(
            "seq",
            *SCORED.names,
            feed_of(F.col("region")).alias("feed"),
            F.to_date("published_at").alias("published_date"),
            F.lit(batch or uuid.uuid4().hex).alias("batch"),
        )
        (
            laid_out.hint("rebalance", "feed", "published_date")
            .sortWithinPartitions("feed", "published_date", "published_at")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("feed", "published_date", "batch")
            .parquet(self.articles_path)
        )

    def take_in(self, scored: DataFrame, stream: str = "", number: int = 0) -> None:
        """Articles, counts, newest and, last, titles of a scored batch; all of it may be done again.

        A batch whose titles are in the index is there whole.
        """
        name = batch_name(stream, number)
        # Three small tables that do not depend on one another: their jobs share the cluster.
        with ThreadPoolExecutor(3) as pool:
            writes = [
                pool.submit(self.append, scored, name),
                pool.submit(self.counts.fold, scored, stream, number),
                pool.submit(self.newest.fold, scored),
            ]
        for write in writes:
            write.result()
        self.titles.add(scored, name)

    def compact_to(self, root: str) -> ScoredStore:
        """A copy with few files per day and feed, for the next start of a stream."""
        copy = ScoredStore(self.spark, root, self.ledger.name)
        whole = self.articles()
        copy.append(whole, "compact")
        copy.counts.fold(whole, "compact", 0)
        copy.newest.fold(whole)
        self.titles.compact_to(copy.titles.path)
        return copy
