"""Topic to scored store: dedup, score and store each micro-batch as one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tickertone.operators.dedup import TITLE_KEY, keyed_first
from tickertone.plans.scorers import Scorer
from tickertone.plans.scoring import score_articles
from tickertone.sources.folders import query_id
from tickertone.sources.store import ScoredStore, batch_name
from tickertone.sources.topic import decode_messages
from tickertone.streaming.arrival import with_arrival


def process_batch(batch: DataFrame, batch_id: int, store: ScoredStore, scorer: Scorer, stream: str = "", **options) -> None:
    """Score and store the new titles of one micro-batch.

    A batch that failed anywhere is run again with the same rows: answers paid for come from the
    ledger, its articles are overwritten, counts know that they have it. Its titles reach the index
    last, and when they are there nothing is left to do.
    """
    name = batch_name(stream, batch_id)
    given = batch.persist()
    fresh = scored = None
    try:
        articles = with_arrival(given, batch_id)
        known = store.titles.find(articles)
        if known is None:
            return
        fresh = keyed_first(articles).join(known, TITLE_KEY, "left_anti").drop(*TITLE_KEY).persist()
        if fresh.isEmpty():
            return
        scored = score_articles(fresh, scorer, ledger=store.ledger, batch=name, **options).persist()
        store.take_in(scored, stream, batch_id)
        store.ledger.forget(name)
    finally:
        for frame in (given, fresh, scored):
            if frame is not None:
                frame.unpersist()


def start_scoring(
    messages: DataFrame, store: ScoredStore, scorer: Scorer, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Start the stream. ``messages`` is ``read_topic(...)`` or ``read_topic_files(...)``."""

    def process(batch: DataFrame, batch_id: int) -> None:
        # Batch numbers begin anew with every checkpoint, the id of the query does too.
        process_batch(batch, batch_id, store, scorer, query_id(store.spark, checkpoint), **options)

    return (
        decode_messages(messages)
        .writeStream.outputMode("append")
        .foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "0 seconds"}))
        .start()
    )
