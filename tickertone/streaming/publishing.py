"""Feed documents to topic: entries, cleaning, title dedup, JSON messages."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickertone.operators.dedup import TITLE_KEY, keyed_first
from tickertone.plans.articles import build_articles, tag_entries
from tickertone.sources.feeds import keep_usable, read_entries
from tickertone.sources.titles import TitleIndex
from tickertone.sources.topic import encode_messages
from tickertone.streaming.arrival import with_arrival

PLACE = ("url", "entry_no")


def feed_articles(documents: DataFrame, registry: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Article records of feed documents; works on a batch and on a stream.

    They keep ``url`` and ``entry_no``, their place, by which the first of equal titles is told.
    """
    return build_articles(tag_entries(keep_usable(read_entries(documents)), registry), as_of, keep=PLACE)


def publish_batch(
    batch: DataFrame, batch_id: int, sent: TitleIndex, write: Callable[[DataFrame], None], run: str | None = None
) -> None:
    """Send the first article of each title not sent before.

    Articles that keep the place of their entry are in order of address and place, so neither the join
    with the registry nor the number of tasks changes which one is the first; equal places, of two
    versions of a document in one batch, are told apart by their values. Others are in order of arrival.
    Copies fold before the shuffle, so a title that fills a third of a batch is one row per task.
    Titles count as sent once ``write`` has returned; a batch that failed is sent again.
    """
    given = batch.persist()
    fresh = None
    try:
        if set(PLACE) <= set(given.columns):
            articles, order = given, F.struct(*PLACE, "published_at", "link", "text")
        else:
            articles, order = with_arrival(given, batch_id), F.col("seq")
        known = sent.find(articles)
        if known is None:
            return
        fresh = keyed_first(articles, order).join(known, TITLE_KEY, "left_anti").drop(*TITLE_KEY).persist()
        if fresh.isEmpty():
            return
        write(encode_messages(fresh))
        sent.add(fresh, run)
    finally:
        for frame in (given, fresh):
            if frame is not None:
                frame.unpersist()


def start_publishing(
    articles: DataFrame,
    sent: TitleIndex,
    write: Callable[[DataFrame], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Publish a stream of articles. ``write`` is a sink such as ``write_topic`` with its address."""

    def process(batch: DataFrame, batch_id: int) -> None:
        publish_batch(batch, batch_id, sent, write)

    return (
        articles.writeStream.outputMode("append")
        .foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .start()
    )


def unsent(articles: DataFrame, horizon: str | None = None, spread: int = 1) -> DataFrame:
    """Each title once over the life of a query, remembered in the checkpointed state store.

    For streams that go on to other streaming operators. Without ``horizon`` titles are kept for
    good; with it, a title may come back after that long and state stays bounded. ``spread`` over
    one first drops the copies each share of the tasks has seen, so that a title with very many
    copies is not one state partition's work; it costs a second shuffle and up to that many state
    rows per title.
    """
    if horizon is not None:
        articles = articles.withWatermark("ingested_at", horizon)

    def once(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.dropDuplicates(keys) if horizon is None else rows.dropDuplicatesWithinWatermark(keys)

    if spread > 1:
        share = F.pmod(F.spark_partition_id(), F.lit(spread))
        articles = once(articles.withColumn("_share", share), ["title", "_share"]).drop("_share")
    return once(articles, ["title"])


def use_large_state(spark: SparkSession) -> None:
    """Title state outgrows the heap at scale; RocksDB keeps it on disk with changelog checkpoints."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
