"""Tables that micro-batches keep, the title index as it grows, and answers paid for once."""

import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickertone.operators import grids, samples
from tickertone.plans import kept_panels, panels
from tickertone.plans.scorers import label_of
from tickertone.sources.kept import KeptCounts, KeptNewest
from tickertone.sources.ledger import ResponseLedger
from tickertone.sources.store import ScoredStore
from tickertone.sources.titles import FAN, TitleIndex
from tickertone.streaming.scoring import process_batch

NOW = datetime(2024, 1, 31, 12, 40, 30, tzinfo=timezone.utc)
SCORED = (
    "seq bigint, title string, text string, link string, source string, region string, published_at timestamp, "
    "ingested_at timestamp, sentiment string, sentiment_score double"
)
ARTICLE = "title string, text string, link string, source string, region string, published_at timestamp, ingested_at timestamp"


def stories(n, seed=0):
    """Late, future and undated ones, ties, unknown regions and unscored ones among them."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        at = NOW - timedelta(seconds=rng.choice([rng.randint(-9000, 90_000), rng.randint(0, 4000), 777]))
        published = None if rng.random() < 0.1 else at
        ingested = None if rng.random() < 0.1 else at + timedelta(seconds=rng.randint(0, 5000))
        score = None if rng.random() < 0.2 else float(rng.randint(-100, 100))
        label = "Unscored" if score is None else label_of(int(score))
        region = rng.choice(["International", "Nepali", None, "", "Elsewhere"])
        rows.append((seq, f"t{seq}", rng.choice(["", "text", None]), "http://x", "s", region, published, ingested, label, score))
    return rows


def plain(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_kept_tables_equal_the_store(spark, tmp_path):
    rows = stories(400)
    store = spark.createDataFrame(rows, SCORED)
    random.Random(4).shuffle(rows)
    batches = [spark.createDataFrame(rows[i::4], SCORED) for i in range(4)]
    for number in [0, 1, 1, 2, 3, 3]:  # batches that run again
        counts, newest = KeptCounts(spark, f"{tmp_path}/c"), KeptNewest(spark, f"{tmp_path}/n", 60)  # as after a restart
        counts.fold(batches[number], "a", number)
        newest.fold(batches[number])
    newest.fold(batches[0])
    minute = kept_panels.whole_minute(NOW)
    assert plain(kept_panels.region_counts(counts)) == plain(panels.region_counts(store))
    assert plain(kept_panels.ingest_rate(counts, NOW)) == plain(panels.ingest_rate(store, minute))
    assert plain(kept_panels.rolling_sentiment(counts, NOW)) == plain(panels.rolling_sentiment(store, minute))
    for spec in (grids.HOURLY, grids.DAILY):
        assert plain(kept_panels.sentiment_grid(counts, NOW, spec)) == plain(grids.sentiment_grid(store, NOW, spec))
    for feed in panels.FEEDS:
        assert list(map(tuple, kept_panels.newest(newest, feed, 60).collect())) == list(map(tuple, samples.newest(store, feed, 60).collect()))
    assert plain(kept_panels.overview(counts, newest, NOW, 60)) == plain(panels.overview(store, minute, 60))


def test_batch_that_stopped_between_two_days(spark, tmp_path):
    """Days that have a batch are left alone when it runs again, the others take it."""
    counts = KeptCounts(spark, str(tmp_path / "counts"))
    batch = spark.createDataFrame(stories(60), SCORED)
    counts.fold(batch.where("published_at < '2024-01-31' AND ingested_at < '2024-01-31'"), "a", 0)
    whole = KeptCounts(spark, str(tmp_path / "whole"))
    whole.fold(batch, "a", 1)
    whole.fold(batch.where("published_at < '2024-01-31' AND ingested_at < '2024-01-31'"), "a", 2)
    counts.fold(batch, "a", 1)
    before = plain(counts.read("published").select("day", "minute", "feed", "sentiment", "stories"))
    # As if the commit had reached all days but one.
    (lost,) = (tmp_path / "counts" / "day=2024-01-31").glob("*.parquet")
    lost.unlink()
    counts.fold(batch, "a", 1)
    assert plain(counts.read("published").select("day", "minute", "feed", "sentiment", "stories")) == before
    assert before == plain(whole.read("published").select("day", "minute", "feed", "sentiment", "stories"))
    counts.fold(batch.where("false"), "a", 2)
    counts.fold(batch, "another stream", 0)
    assert counts.read("total").agg(F.sum("stories")).first()[0] == sum(1 for _ in stories(60)) * 2 + batch.where("published_at < '2024-01-31' AND ingested_at < '2024-01-31'").count()


def test_panels_read_days_not_the_store(spark, tmp_path):
    counts = KeptCounts(spark, str(tmp_path))
    old = [(i, f"o{i}", "", "", "s", "Nepali", NOW - timedelta(days=30 + i), NOW - timedelta(days=30 + i), "Neutral", 1.0) for i in range(40)]
    counts.fold(spark.createDataFrame(old + stories(50), SCORED), "a", 0)
    rolling = kept_panels.rolling_sentiment(counts, NOW)
    plan = rolling._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "day" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    whole = read_by(spark, lambda: counts.read("published").collect())
    assert read_by(spark, rolling.collect) < whole / 4


def read_by(spark, action):
    """Bytes that the scans of an action read."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = sc._gateway.new_array(sc._jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).inputBytes() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


def titles(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("A headline of the usual length, number "), F.col("id").cast("string")).alias("title"))


def test_index_lookup_stays_flat(spark, tmp_path):
    """Fifty batches on top of a large history: files stay few, and a lookup reads a small part of them."""
    index, history = TitleIndex(spark, str(tmp_path)), 500_000
    index.add(titles(spark, 0, history))
    wanted = spark.createDataFrame([(f"A headline of the usual length, number {i}",) for i in (7, 123_456, 499_999, 500_150, 10**9, 10**9 + 1)], "title string").persist()
    used = {}
    for batch in range(50):
        index.add(titles(spark, history + batch * 200, history + (batch + 1) * 200), f"b{batch}")
        if batch in (0, 20, 49):
            found = []
            read = read_by(spark, lambda: found.extend(index.find(wanted).collect()))
            used[batch] = (len(found), read, len(index.read().inputFiles()))
    whole = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert [n for n, _, _ in used.values()] == [4, 4, 4]
    # Each file costs a footer and the pages met, in the reads of 64 KB that local files are read by.
    assert all(read < 300_000 + 130_000 * files and files <= 2 * FAN for _, read, files in used.values()), used
    assert used[0][1] < whole / 10, (used, whole)


def test_index_is_a_set_of_titles(spark, tmp_path):
    index = TitleIndex(spark, str(tmp_path))
    schema = "title string"
    for i in range(2 * FAN):
        batch = spark.createDataFrame([(f"t{i}",), ("same",), (None,), ("",)], schema)
        index.add(batch, f"r{i}")
        index.add(batch, f"r{i}")  # replayed
    assert len(index.runs(0)) < FAN and len(index.runs(1)) >= 1
    copy = index.compact_to(f"{tmp_path}-copy")
    assert copy.read().count() == 2 * FAN + 3
    asked = spark.createDataFrame([("t0",), ("t15",), ("t16",), (None,), ("",), ("Same",)], schema)
    for where in (index, copy):
        assert sorted((r._title, r._untitled) for r in where.find(asked).collect()) == [("", False), ("", True), ("t0", False), ("t15", False)]
    many = spark.range(3000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
    assert index.find(many).count() == 2 * FAN  # beyond what is looked up by hash
    assert index.find(asked.where("false")) is None


@pytest.fixture
def counting(tmp_path):
    """A scorer that leaves a file for each call."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def score(headlines, region):
        (folder / uuid.uuid4().hex).write_text("|".join(headlines))
        if "bad" in headlines and not (folder / "mended").exists():
            raise ValueError("no answer")
        return [{"score": len(h), "sentiment": label_of(len(h)), "sentiment_model": "m"} for h in headlines]

    score.calls = lambda: sorted(p.read_text() for p in folder.iterdir() if p.name != "mended")
    score.mend = lambda: (folder / "mended").write_text("")
    return score


def article(title, region="International"):
    return (title, "t", "http://x", "s", region, NOW, NOW)


def test_each_request_is_paid_once(spark, tmp_path, counting):
    store = ScoredStore(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([article(f"t{i:02}") for i in range(12)] + [article("n", "Nepali"), article(" ")], ARTICLE).coalesce(1)

    def lost(*_):
        raise RuntimeError("executor lost")

    for step in ("append", "titles"):
        whole = getattr(store, step)
        if step == "append":
            store.append = lost
        else:
            store.titles.add = lost
        with pytest.raises(RuntimeError, match="executor lost"):
            process_batch(batch, 3, store, counting, "s")
        if step == "append":
            store.append = whole
        else:
            del store.titles.add
    process_batch(batch, 3, store, counting, "s")
    process_batch(batch, 3, store, counting, "s")
    assert counting.calls() == ["n", "t00|t01|t02|t03|t04", "t05|t06|t07|t08|t09", "t10|t11"]
    assert store.articles().count() == 14 and store.articles().select("batch").distinct().count() == 1
    assert kept_panels.region_counts(store.counts).where("feed = 'International'").first().records == 13
    assert store.ledger.answers("s-0000000003").isEmpty()


def test_failed_request_leaves_the_others_paid(spark, tmp_path, counting):
    store = ScoredStore(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([article(f"t{i:02}") for i in range(5)] + [article("bad", "Nepali")], ARTICLE).coalesce(1)
    with pytest.raises(RuntimeError, match="ValueError: no answer"):
        process_batch(batch, 0, store, counting)
    assert store.articles().count() == 0
    counting.mend()
    process_batch(batch, 0, store, counting)
    assert counting.calls() == ["bad", "bad", "t00|t01|t02|t03|t04"]
    assert store.articles().count() == 6


def test_ledger_knows_content_and_scorer(spark, tmp_path):
    requests = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "place int, body string")
    asked = spark.sparkContext.accumulator(0)

    def ask(request):
        asked.add(1)
        return [{"score": 7, "sentiment": "Neutral", "sentiment_model": "m"}]

    for name, calls in (("one", 2), ("one", 2), ("two", 4)):
        ledger = ResponseLedger(spark, str(tmp_path), name)
        assert ledger.ask(requests, ask, ["body"], "b", 2).count() == 3
        assert asked.value == calls
    assert ledger.ask(requests.where("false"), ask, ["body"], "c", 2).count() == 0
