"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over the whole test tables.

Timestamps leave as ``timestamp_ntz`` and counts as ``bigint``, so both engines show one schema.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickertone.functions.sentiment import language
from tickertone.functions.text import blank, clean_text, excerpt
from tickertone.operators import grids
from tickertone.operators.batching import assign_batches, pending_headlines
from tickertone.operators.dedup import first_per_title, new_articles, stored_hits
from tickertone.operators.responses import (
    fallback_body,
    map_responses,
    primary_body,
    read_results,
    resolve_fallback,
    valid_results,
)
from tickertone.operators.samples import newest, normalise
from tickertone.plans import kept_panels, panels
from tickertone.plans.articles import build_articles, tag_entries
from tickertone.plans.report import batch_report
from tickertone.plans.requests import build_requests
from tickertone.plans.scoring import merge_scores, no_scores, score_articles, score_new_articles
from tickertone.schemas import EXCERPT_CHARS, FALLBACK_MODEL, PRIMARY_MODEL
from tickertone.session import use_placement
from tickertone.sources import feeds
from tickertone.sources.registry import count_by_region, default_registry
from tickertone.sources.kept import KeptCounts, KeptNewest
from tickertone.sources.store import ScoredStore
from tickertone.sources.titles import TitleIndex
from tickertone.sources.topic import decode_messages, encode_messages, read_topic_files, write_topic_files
from tickertone.streaming.live import bucket_counts, read_bucket_counts, start_bucket_counts
from tickertone.streaming.publishing import unsent
from tickertone.streaming.scoring import start_scoring
from workload import tables
from workload.scorer import fixture_scorer

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}


def _settle(df: DataFrame) -> DataFrame:
    """Zone-free timestamps."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
            for f in df.schema.fields
        ]
    )


def query(build: Query) -> Query:
    name = build.__name__.removesuffix("_query")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _settle(build(spark, sf_dir))

    _REGISTERED[name] = run
    return build


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


def _both(sample: Callable[[str], DataFrame]) -> DataFrame:
    parts = [sample(feed).withColumn("feed", F.lit(feed)) for feed in panels.FEEDS]
    return parts[0].unionByName(parts[1])


# The articles are spread by the key of the join that makes them.
PLACE = "d_id"


def _placed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.articles(use_placement(spark), sf_dir, keep=(PLACE,))


# --- sources -----------------------------------------------------------------------------------


@query
def feed_registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources per region; nations and their regions stand for feeds and theirs."""
    nation, region = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "region")
    registry = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("source"), F.col("r_name").alias("region")
    )
    return count_by_region(registry)


@query
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = feeds.read_entries(tables.feed_documents(spark, sf_dir))
    return entries.select("url", "malformed", "entry_no", "title", "link", F.coalesce("summary", "description").alias("summary"))


@query
def feed_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = feeds.read_entries(tables.feed_documents(spark, sf_dir))
    return feeds.keep_usable(entries).select("url", "malformed", "title", "link")


@query
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries found and kept of feed files with bad bytes, broken entries, CDATA end tags and nothing in them."""
    return feeds.feed_health(feeds.decoded(tables.damaged_feed_files(spark, sf_dir)))


@query
def stored_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock, rows = tables.as_of(spark, sf_dir), tables.articles(spark, sf_dir)
    return stored_hits(tables.stored_articles(rows, clock), tables.arriving_articles(rows, clock))


@query
def article_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_messages(encode_messages(tables.articles(spark, sf_dir)))


@query
def batch_score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_report(_placed_articles(spark, sf_dir), fixture_scorer, near=PLACE)


# --- records -----------------------------------------------------------------------------------


@query
def article_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are broken, carry a number as title and no readable time, or three fields only."""
    seq = F.col("seq")
    fields = F.struct("title", "link", "source")
    number = F.struct(seq.alias("title"), F.lit("soon").alias("ingested_at"))
    rows = tables.articles(spark, sf_dir).withColumns(
        {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in ("published_at", "ingested_at")}
    )
    full = F.struct("title", "text", "link", "source", "region", "published_at", "ingested_at")
    value = (
        F.when(seq % 13 == 0, F.concat(F.lit("{oops "), seq.cast("string")))
        .when(seq % 17 == 0, F.to_json(number))
        .when(seq % 19 == 0, F.to_json(fields))
        .otherwise(F.to_json(full))
    )
    return decode_messages(rows.select("seq", F.encode(value, "UTF-8").alias("value")))


@query
def clean_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", clean_text(F.col("html")).alias("text"))


@query
def excerpt_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    text = excerpt(none, F.lit(""), F.col("text"), EXCERPT_CHARS)
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return rows.withColumn("chars", F.length("text").cast("long"))


@query
def article_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = tables.page_entries(spark, sf_dir).select("page_id", "url")
    return tag_entries(entries, default_registry(spark))


@query
def article_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tag_entries(tables.page_entries(spark, sf_dir), default_registry(spark))
    return build_articles(tagged, tables.as_of(spark, sf_dir), keep=("page_id",))


@query
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script rule with a Latin range, since the documents hold no Devanagari."""
    told = language(F.col("text"), "[\\u00C0-\\u00FF]", "Accented", "Plain")
    return tables.table(spark, sf_dir, "documents").select("doc_id", told.alias("language"))


# --- dedup -------------------------------------------------------------------------------------


@query
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_title(_placed_articles(spark, sf_dir), near=PLACE).drop(PLACE)


@query
def new_articles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock, rows = tables.as_of(spark, sf_dir), _placed_articles(spark, sf_dir)
    return new_articles(tables.arriving_articles(rows, clock), tables.stored_articles(rows, clock), near=PLACE).drop(PLACE)


# --- scoring -----------------------------------------------------------------------------------


@query
def score_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock, rows = tables.as_of(spark, sf_dir), tables.articles(spark, sf_dir)
    fresh = new_articles(tables.arriving_articles(rows, clock), tables.stored_articles(rows, clock))
    return assign_batches(pending_headlines(fresh))


@query
def score_batches_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the whole stream, so the regions are as uneven as they come."""
    return assign_batches(pending_headlines(tables.articles(spark, sf_dir)), block_bits=10)


@query
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_requests(tables.request_rows(spark, sf_dir)).drop("seqs", "headlines")


@query
def unscored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.articles(spark, sf_dir)
    return merge_scores(rows.where(blank(F.col("title"))), no_scores(spark))


@query
def scored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_articles(_placed_articles(spark, sf_dir), fixture_scorer, near=PLACE).drop(PLACE)


@query
def sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New articles scored, then counted per label: the flagship."""
    clock, rows = tables.as_of(spark, sf_dir), tables.articles(spark, sf_dir)
    arriving, stored = tables.arriving_articles(rows, clock), tables.stored_articles(rows, clock)
    return panels.sentiment_mix(score_new_articles(arriving, stored, fixture_scorer))


@query
def response_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.envelope_rows(spark, sf_dir)
    return rows.select(
        "region_key",
        "batch_no",
        primary_body(F.col("primary_response")).alias("primary_text"),
        fallback_body(F.col("fallback_response")).alias("fallback_text"),
    )


@query
def response_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_results(read_results(F.col("body")), F.size("headlines"))
    return tables.response_rows(spark, sf_dir).select("region_key", "batch_no", "variant", valid.alias("valid"))


@query
def response_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_responses(tables.response_rows(spark, sf_dir))


@query
def scorer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_fallback(tables.envelope_rows(spark, sf_dir), PRIMARY_MODEL, FALLBACK_MODEL)
    return resolved.select(
        "region_key",
        "batch_no",
        "sentiment_model",
        F.coalesce(F.size(read_results(F.col("body"))), F.lit(0)).cast("long").alias("scores"),
    )


# --- analytics ---------------------------------------------------------------------------------


@query
def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.region_counts(tables.scored(spark, sf_dir))


@query
def ingest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.ingest_rate(tables.scored(spark, sf_dir), tables.as_of(spark, sf_dir))


@query
def rolling_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.rolling_sentiment(tables.scored(spark, sf_dir), tables.as_of(spark, sf_dir))


@query
def newest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.scored(spark, sf_dir)
    return _both(lambda feed: newest(rows, feed))


@query
def normalized_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without link and source, the score as text that cannot always be read."""
    rows = tables.scored(spark, sf_dir)
    loose = F.when(F.col("seq") % 5 == 0, "n/a").otherwise(F.col("sentiment_score").cast("string"))
    ragged = rows.select(
        "seq", "title", "text", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("region")).alias("region"),
        "sentiment", loose.alias("sentiment_score"), F.col("published_at").cast("string").alias("published_at"),
    )
    return normalise(ragged)


@query
def story_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.scored(spark, sf_dir)
    return _both(lambda feed: panels.story_list(panels.sample(rows, feed)))


@query
def sentiment_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.scored(spark, sf_dir)
    return _both(lambda feed: panels.sentiment_mix(panels.sample(rows, feed)))


@query
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.scored(spark, sf_dir)
    return _both(lambda feed: panels.source_counts(panels.sample(rows, feed)))


@query
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.scored(spark, sf_dir)
    return _both(lambda feed: panels.coverage(panels.sample(rows, feed)))


@query
def hourly_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, clock = tables.scored(spark, sf_dir), tables.as_of(spark, sf_dir)
    return _both(lambda feed: grids.sentiment_grid(panels.sample(rows, feed), clock, grids.HOURLY))


@query
def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, clock = tables.scored(spark, sf_dir), tables.as_of(spark, sf_dir)
    return _both(lambda feed: grids.sentiment_grid(panels.sample(rows, feed), clock, grids.DAILY))


@query
def hourly_sentiment_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.sentiment_grid(tables.scored(spark, sf_dir), tables.as_of(spark, sf_dir), grids.HOURLY)


@query
def daily_sentiment_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.sentiment_grid(tables.scored(spark, sf_dir), tables.as_of(spark, sf_dir), grids.DAILY)


@query
def region_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.overview(tables.scored(spark, sf_dir), tables.as_of(spark, sf_dir))


# --- streams -----------------------------------------------------------------------------------


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run, in the shared checkpoint folder; its own only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared}/tickertone-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tickertone-")


@query
def stream_scored_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after the stream took in the arriving articles on top of the stored ones."""
    clock, rows, run = tables.as_of(spark, sf_dir), _placed_articles(spark, sf_dir), run_folder(spark)
    store = ScoredStore(spark, f"{run}/store")
    # The tables beside the store are made from them one by one.
    stored = first_per_title(tables.stored_articles(rows, clock), near=PLACE).drop(PLACE).persist()
    scored = score_articles(stored, fixture_scorer).persist()
    try:
        store.take_in(scored, "stored")
    finally:
        scored.unpersist()
        stored.unpersist()
    write_topic_files(encode_messages(tables.arriving_articles(rows, clock)), f"{run}/topic", packed=True)
    stream = start_scoring(
        read_topic_files(spark, f"{run}/topic", max_files=4, packed=True), store, fixture_scorer, f"{run}/checkpoint",
        trigger={"availableNow": True},
    )
    stream.awaitTermination()
    kept = store.articles()
    return kept.select("title", "sentiment", "sentiment_score", "sentiment_language", "sentiment_model")


@query
def stream_title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles a publishing stream lets through, each once."""
    run = run_folder(spark)
    write_topic_files(encode_messages(tables.articles(spark, sf_dir)), f"{run}/topic", packed=True)
    titles = unsent(decode_messages(read_topic_files(spark, f"{run}/topic", packed=True)).select("title"), spread=8)
    _drain(titles, run)
    return spark.read.schema("title string").parquet(f"{run}/out")


@query
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly local counts kept by the stream, of every dated record however late."""
    run = run_folder(spark)
    rows = tables.scored(spark, sf_dir).select("published_at", "sentiment")
    rows.write.parquet(f"{run}/scored")
    source = spark.readStream.schema("published_at timestamp, sentiment string").option("maxFilesPerTrigger", 8)
    counts = bucket_counts(source.parquet(f"{run}/scored"), "hour")
    start_bucket_counts(counts, f"{run}/out", f"{run}/checkpoint", {"availableNow": True}).awaitTermination()
    return read_bucket_counts(spark, f"{run}/out")


def _batches(rows: DataFrame, n: int = 3) -> list[DataFrame]:
    """All rows in n parts, not in the order of their times."""
    return [rows.where(F.col("seq") % n == k) for k in range(n)]


def _kept_counts(spark: SparkSession, sf_dir: str) -> KeptCounts:
    counts = KeptCounts(spark, f"{run_folder(spark)}/counts")
    for number, rows in enumerate(_batches(tables.scored(spark, sf_dir))):
        counts.fold(rows, "stream", number)
    return counts


def _kept_newest(spark: SparkSession, sf_dir: str) -> KeptNewest:
    newest_ = KeptNewest(spark, f"{run_folder(spark)}/newest")
    for rows in _batches(tables.scored(spark, sf_dir)):
        newest_.fold(rows)
    return newest_


@query
def kept_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline numbers from what micro-batches keep, as of the clock's whole minute."""
    return kept_panels.overview(_kept_counts(spark, sf_dir), _kept_newest(spark, sf_dir), tables.as_of(spark, sf_dir))


@query
def kept_hourly_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_panels.sentiment_grid(_kept_counts(spark, sf_dir), tables.as_of(spark, sf_dir), grids.HOURLY)


@query
def kept_daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_panels.sentiment_grid(_kept_counts(spark, sf_dir), tables.as_of(spark, sf_dir), grids.DAILY)


@query
def kept_newest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept_newest(spark, sf_dir)
    return _both(lambda feed: kept_panels.newest(kept, feed))


@query
def indexed_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the arriving articles that an index made by many micro-batches has."""
    clock, rows = tables.as_of(spark, sf_dir), tables.articles(spark, sf_dir)
    index = TitleIndex(spark, f"{run_folder(spark)}/titles")
    for batch in _batches(tables.stored_articles(rows, clock).select("seq", "title"), 9):
        index.add(batch)
    hits = index.find(tables.arriving_articles(rows, clock))
    if hits is None:
        return spark.createDataFrame([], "title string")
    return hits.select(F.when(~F.col("_untitled"), F.col("_title")).alias("title"))


def _drain(frame: DataFrame, run: str) -> None:
    (
        frame.writeStream.format("parquet")
        .option("path", f"{run}/out")
        .option("checkpointLocation", f"{run}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
