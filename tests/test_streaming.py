import time
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tickertone.operators import grids
from tickertone.plans.scorers import label_of
from tickertone.sources.feeds import read_feed_files
from tickertone.sources.registry import FEEDS, default_registry
from tickertone.sources.store import ScoredStore
from tickertone.sources.titles import TitleIndex
from tickertone.sources.topic import decode_messages, encode_messages, read_topic_files, write_topic_files
from tickertone.streaming.arrival import with_arrival
from tickertone.streaming.live import bucket_counts, current_panels, read_bucket_counts, start_bucket_counts, start_refresh, write_panels
from tickertone.streaming.publishing import feed_articles, publish_batch, start_publishing, unsent
from tickertone.streaming.scoring import process_batch, start_scoring
from test_feeds import RSS, TRAILING

NOW = datetime(2024, 1, 31, 12, 40, tzinfo=timezone.utc)
ARTICLE = "title string, text string, link string, source string, region string, published_at timestamp, ingested_at timestamp"


def scorer(headlines, region):
    return [{"score": len(h), "sentiment": label_of(len(h)), "sentiment_model": "m"} for h in headlines]


def failing(headlines, region):
    raise RuntimeError("provider down")


def article(title, text="t", region="International", published=NOW, ingested=NOW):
    return (title, text, "http://x", "s", region, published, ingested)


def publish(spark, folder, *batches):
    """Each batch becomes one file of the topic folder, in order."""
    for rows in batches:
        encode_messages(spark.createDataFrame(rows, ARTICLE).coalesce(1)).write.mode("append").text(str(folder))


def run(spark, tmp_path, store, use=scorer, **options):
    messages = read_topic_files(spark, str(tmp_path / "topic"), max_files=1)
    query = start_scoring(messages, store, use, str(tmp_path / "checkpoint"), trigger={"availableNow": True}, **options)
    query.awaitTermination()
    return query


def titles(store):
    return sorted("-" if r.title is None else r.title for r in store.articles().collect())


@pytest.mark.parametrize("rows, size", [(100_000, "10m"), (0, "-1")])
def test_the_first_of_equal_titles_does_not_depend_on_the_size_of_the_registry(spark, tmp_path, monkeypatch, rows, size):
    # One title stands twice in each document, others in one only; the first address is not registered.
    story = "<item><title>{}</title><link>http://{}/{}</link></item>"
    document = "<rss version='2.0'><channel>{}</channel></rss>"
    feeds = [
        (f"http://feed/{n:02}", document.format("".join(story.format(t, n, at) for at, t in enumerate([f"only {n}", "same", "same"]))))
        for n in range(40)
    ]
    documents = spark.createDataFrame(feeds, "url string, document string").withColumn("damaged", F.lit(False)).repartition(7)
    registered = F.format_string("http://feed/%02d", "id").alias("url")
    registry = spark.range(1, 40).select(registered, F.lit("s").alias("source"), F.lit("r").alias("region"))
    got = []

    def keep(messages):
        got.extend((r.title, r.link) for r in decode_messages(messages).collect())

    monkeypatch.setattr("tickertone.plans.articles.REGISTRY_BROADCAST_ROWS", rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        articles = feed_articles(documents, registry, NOW)
        plan = articles._jdf.queryExecution().executedPlan().toString()
        publish_batch(articles, 0, TitleIndex(spark, str(tmp_path / "sent")), keep)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in plan) == (rows == 0)
    assert sorted(got) == sorted([("same", "http://1/1"), *[(f"only {n}", f"http://{n}/0") for n in range(1, 40)]])


def test_dedup_across_batches_and_restarts(spark, tmp_path):
    store = ScoredStore(spark, str(tmp_path / "store"))
    publish(spark, tmp_path / "topic", [article("a", "first"), article("a", "second"), article(None), article("")], [article("a"), article("b"), article(None)])
    run(spark, tmp_path, store)
    assert titles(store) == ["", "-", "a", "b"]
    publish(spark, tmp_path / "topic", [article("b"), article("c"), article("")])
    run(spark, tmp_path, store)
    assert titles(store) == ["", "-", "a", "b", "c"]
    assert [r.text for r in store.articles().where("title = 'a'").collect()] == ["first"]
    assert store.articles().select("seq").distinct().count() == 5
    assert store.titles.read().count() == 5


def test_fresh_checkpoint_reads_all_but_stores_nothing_twice(spark, tmp_path):
    store = ScoredStore(spark, str(tmp_path / "store"))
    publish(spark, tmp_path / "topic", [article("a"), article("b")])
    run(spark, tmp_path, store)
    messages = read_topic_files(spark, str(tmp_path / "topic"))
    start_scoring(messages, store, scorer, str(tmp_path / "other"), trigger={"availableNow": True}).awaitTermination()
    assert titles(store) == ["a", "b"]


def test_failed_scorer_stops_the_query_and_the_batch_is_run_again(spark, tmp_path):
    store = ScoredStore(spark, str(tmp_path / "store"))
    publish(spark, tmp_path / "topic", [article("a"), article(" ")])
    with pytest.raises(Exception, match="provider down"):
        run(spark, tmp_path, store, failing)
    assert titles(store) == []
    run(spark, tmp_path, store)
    assert titles(store) == [" ", "a"]


def test_replay_after_a_stop_between_the_two_writes(spark, tmp_path):
    store = ScoredStore(spark, str(tmp_path / "store"))
    rows = [article("a"), article("b", published=None), article(None, ingested=None), article("c", published=NOW - timedelta(days=90))]
    batch = spark.createDataFrame(rows, ARTICLE)
    add, store.titles.add = store.titles.add, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        process_batch(batch, 7, store, scorer)
    assert titles(store) == ["-", "a", "b", "c"] and store.titles.read().count() == 0
    store.titles.add = add
    process_batch(batch, 7, store, failing)  # nothing is left to score
    assert titles(store) == ["-", "a", "b", "c"] and store.titles.read().count() == 4
    process_batch(batch, 7, store, failing)
    assert store.articles().count() == 4 and store.titles.read().count() == 4


def test_empty_batch_does_nothing(spark, tmp_path):
    store = ScoredStore(spark, str(tmp_path / "store"))
    process_batch(spark.createDataFrame([], ARTICLE), 0, store, failing)
    assert store.articles().count() == 0


def test_store_layout(spark, tmp_path):
    store = ScoredStore(spark, str(tmp_path / "store"))
    publish(spark, tmp_path / "topic", [article("a"), article("b", region=None), article("c", region="Nepali"), article("d", region="", published=None)])
    run(spark, tmp_path, store, tasks=2)
    got = {r.title: (r.feed, r.region, str(r.published_date)) for r in store.articles().collect()}
    assert got == {
        "a": ("International", "International", "2024-01-31"), "b": ("International", None, "2024-01-31"),
        "c": ("Nepali", "Nepali", "2024-01-31"), "d": (None, "", "None"),
    }


def test_feeds_to_topic_to_store(spark, tmp_path):
    url = FEEDS[1][0]
    folder = tmp_path / "feeds" / f"url={quote(url, safe='')}"
    folder.mkdir(parents=True)
    (folder / "a.xml").write_text(RSS)

    sent = TitleIndex(spark, str(tmp_path / "sent_titles"))

    def publish_pass():
        documents = read_feed_files(spark, str(tmp_path / "feeds"), stream=True, max_files=1)
        articles = feed_articles(documents, default_registry(spark), NOW)
        to_files = lambda messages: write_topic_files(messages, str(tmp_path / "topic"))
        start_publishing(articles, sent, to_files, str(tmp_path / "sent"), {"availableNow": True}).awaitTermination()

    publish_pass()
    first = decode_messages(spark.read.text(str(tmp_path / "topic")))
    assert sorted(r.title for r in first.collect()) == ["", "Guid only", "No link", "Rates & prices"]
    (folder / "b.xml").write_text(RSS)
    (folder / "c.xml").write_text(TRAILING)
    publish_pass()
    sent = decode_messages(spark.read.text(str(tmp_path / "topic")))
    assert sorted(r.title for r in sent.collect()) == ["", "Guid only", "Harbour reopens", "No link", "Rates & prices"]
    store = ScoredStore(spark, str(tmp_path / "store"))
    run(spark, tmp_path, store)
    got = {r.title: (r.sentiment, r.source, r.region) for r in store.articles().collect()}
    assert got["Harbour reopens"] == ("Neutral", "Onlinekhabar", "Nepali") and got[""][0] == "Unscored" and len(got) == 5


def test_titles_count_as_sent_after_the_send(spark, tmp_path):
    sent = TitleIndex(spark, str(tmp_path / "titles"))
    batch = spark.createDataFrame([article("a"), article("a"), article("b")], ARTICLE)

    def down(messages):
        raise RuntimeError("broker down")

    with pytest.raises(RuntimeError, match="broker down"):
        publish_batch(batch, 0, sent, down)
    got = []
    keep = lambda messages: got.extend(r.title for r in decode_messages(messages).collect())
    publish_batch(batch, 0, sent, keep)
    publish_batch(batch, 1, sent, keep)
    publish_batch(batch.where("false"), 2, sent, keep)
    assert sorted(got) == ["a", "b"]


@pytest.mark.parametrize("horizon, spread", [("1 hour", 1), ("1 hour", 4), (None, 4)])
def test_title_memory(spark, tmp_path, horizon, spread):
    publish(spark, tmp_path / "topic", [article("a"), article("a"), article("b")], [article("a"), article(None), article("c")])

    def kept():
        rows = decode_messages(read_topic_files(spark, str(tmp_path / "topic"), max_files=1))
        query = (
            unsent(rows, horizon, spread).select("title").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(str(r.title) for r in spark.read.schema("title string").parquet(str(tmp_path / "out")).collect())

    assert kept() == ["None", "a", "b", "c"]
    publish(spark, tmp_path / "topic", [article("b"), article("d")])
    assert kept() == ["None", "a", "b", "c", "d"]


def test_compaction_keeps_everything(spark, tmp_path):
    store = ScoredStore(spark, str(tmp_path / "store"))
    for i in range(3):
        process_batch(spark.createDataFrame([article(f"t{i}"), article("same"), article(None)], ARTICLE), i, store, scorer)
    store.titles.add(store.articles())  # index rows may repeat
    copy = store.compact_to(str(tmp_path / "copy"))
    assert titles(copy) == titles(store) == ["-", "same", "t0", "t1", "t2"]
    same = lambda s: sorted(map(tuple, s.articles().drop("batch").collect()))
    assert same(copy) == same(store)
    assert sorted(map(tuple, copy.newest.read().collect())) == sorted(map(tuple, store.newest.read().collect()))
    assert copy.titles.read().count() == 5 and len(copy.articles().inputFiles()) < len(store.articles().inputFiles())
    process_batch(spark.createDataFrame([article("t1"), article("new")], ARTICLE), 3, copy, scorer)
    assert titles(copy) == ["-", "new", "same", "t0", "t1", "t2"]


@pytest.mark.parametrize("unit, spec", [("hour", grids.HOURLY), ("day", grids.DAILY)])
def test_stream_counts_equal_the_grid(spark, tmp_path, unit, spec):
    rows = spark.range(400).select(
        (F.lit(NOW) - F.make_dt_interval(mins=(F.col("id") * 17).cast("int"))).alias("published_at"),
        F.element_at(F.array(*map(F.lit, ["Positive", "Neutral", "Negative"])), (F.col("id") % 3 + 1).cast("int")).alias("sentiment"),
    )
    rows.repartition(3).write.parquet(str(tmp_path / "s"))
    source = spark.readStream.schema("published_at timestamp, sentiment string").parquet(str(tmp_path / "s"))
    query = (
        start_bucket_counts(bucket_counts(source, unit), str(tmp_path / "o"), str(tmp_path / "c"), {"availableNow": True})
    )
    query.awaitTermination()
    grid = {(r.bucket, r.sentiment): r.stories for r in grids.sentiment_grid(rows, NOW, spec).collect() if r.stories}
    live = {(r.bucket, r.sentiment): r.stories for r in read_bucket_counts(spark, str(tmp_path / "o")).collect()}
    assert grid and all(live[key] == n for key, n in grid.items())


def test_panel_tables(spark, tmp_path):
    store = ScoredStore(spark, str(tmp_path / "store"))
    publish(spark, tmp_path / "topic", [article("a"), article("a long headline to be positive"), article("c", region="Nepali")])
    run(spark, tmp_path, store)
    folder = str(tmp_path / "panels")
    write_panels(store, folder, NOW + timedelta(minutes=1))
    now = current_panels(spark, folder)
    assert spark.read.parquet(f"{now}/overview").where("feed = 'International'").first().count_60m == 2
    assert spark.read.parquet(f"{now}/Nepali/hourly_sentiment").agg(F.sum("stories")).first()[0] == 1
    reader = spark.read.parquet(f"{now}/Nepali/daily_sentiment")
    for i in range(2, 5):  # a reader of a version is not disturbed by newer ones
        write_panels(store, folder, NOW + timedelta(minutes=i))
    assert current_panels(spark, folder) != now and reader.count() == 21
    (tmp_path / "panels" / "99999999-half-written").mkdir()
    assert spark.read.parquet(f"{current_panels(spark, folder)}/overview").count() == 2
    query = start_refresh(spark, store, str(tmp_path / "live"), str(tmp_path / "tick"), "1 second")
    deadline = time.time() + 60
    while not (query.lastProgress and query.lastProgress["batchId"] >= 1) and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    mix = spark.read.parquet(f"{current_panels(spark, str(tmp_path / 'live'))}/International/sentiment_mix")
    assert {(r.sentiment, r.stories) for r in mix.collect()} == {("Neutral", 1), ("Positive", 1)}


def test_late_and_future_stories_are_counted(spark, tmp_path):
    schema = "published_at timestamp, sentiment string"
    days = [[NOW], [NOW + timedelta(days=30)], [NOW, NOW - timedelta(days=90)], [None]]

    def drain():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
        start_bucket_counts(bucket_counts(source, "day"), str(tmp_path / "o"), str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
        return sorted(r.stories for r in read_bucket_counts(spark, str(tmp_path / "o")).collect())

    for stories in days:
        spark.createDataFrame([(at, "Neutral") for at in stories], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    assert drain() == [1, 1, 2]
    spark.createDataFrame([(NOW, "Neutral")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    assert drain() == [1, 1, 3]
    table = spark.read.parquet(str(tmp_path / "o"))
    assert table.count() == 3 and len(table.inputFiles()) == 3  # one row a bucket, one file a day


@pytest.mark.parametrize("batch_id", [0, 32_767, 32_768, 10**9])
def test_arrival_numbers_last(spark, batch_id):
    rows = spark.range(1000).repartition(7).where("id % 5 <> 2")
    got = sorted(r.seq for r in with_arrival(rows, batch_id).collect())
    assert got == [batch_id * 2**32 + i for i in range(800)]
    assert with_arrival(rows.withColumn("seq", F.col("id")), batch_id).columns == ["id", "seq"]


def test_arrival_numbers_of_many_tasks(spark):
    rows = spark.range(0, 2000, 1, 1000).where("id >= 1500")
    numbered = with_arrival(rows, 5).agg(F.count_distinct("seq"), F.max("seq")).first()
    assert tuple(numbered) == (500, 5 * 2**32 + 499)


def test_arrival_numbers_do_not_run_over(spark):
    with pytest.raises(ValueError, match="no room"):
        with_arrival(spark.range(3), 2**31)


def test_long_titles_are_not_broadcast(spark, tmp_path):
    index = TitleIndex(spark, str(tmp_path / "titles"))
    wide = spark.range(30).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 1_000_000)).alias("title"))
    index.add(wide)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = index.find(wide.where("title like '3x%'"))
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in index.find(wide)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_grids_on_the_store_read_recent_days_only(spark, tmp_path):
    store = ScoredStore(spark, str(tmp_path / "store"))
    process_batch(spark.createDataFrame([article("a")], ARTICLE), 0, store, scorer)
    plan = grids.sentiment_grid(store.articles(), NOW, grids.HOURLY)._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "FileScan" in line).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "published_date" in filters
