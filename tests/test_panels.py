from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickertone.operators import grids
from tickertone.operators.samples import newest, newest_bound, normalise
from tickertone.plans import panels

NOW = datetime(2024, 1, 31, 12, 40, tzinfo=timezone.utc)
SCHEMA = (
    "seq bigint, title string, text string, link string, source string, region string, published_at timestamp, "
    "ingested_at timestamp, sentiment string, sentiment_score double"
)


def before(**delta):
    return NOW - timedelta(**delta)


def row(seq, region="International", published=NOW, ingested=NOW, score=10.0, sentiment="Neutral", text="t", source="s", title="t", link="http://x"):
    return (seq, title, text, link, source, region, published, ingested, sentiment, score)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_feed(df):
    return {r.feed: r.asDict() for r in df.collect()}


def test_region_counts(spark):
    rows = [row(1), row(2, region=None), row(3, region="Nepali"), row(4, region=""), row(5, region="nepali")]
    got = by_feed(panels.region_counts(frame(spark, rows)))
    assert got["International"]["records"] == 2 and got["Nepali"]["records"] == 1
    assert {g["all_records"] for g in got.values()} == {5}
    empty = by_feed(panels.region_counts(frame(spark, [])))
    assert {(g["records"], g["all_records"]) for g in empty.values()} == {(0, 0)}


def test_ingest_rate_has_no_upper_bound(spark):
    rows = [row(1, ingested=before(hours=1)), row(2, ingested=before(hours=1, seconds=1)), row(3, ingested=before(hours=-5)), row(4, ingested=None)]
    got = by_feed(panels.ingest_rate(frame(spark, rows), NOW))
    assert (got["International"]["recent"], got["International"]["per_minute"]) == (2, pytest.approx(2 / 60))
    assert (got["Nepali"]["recent"], got["Nepali"]["per_minute"]) == (0, 0.0)


def test_rolling_windows_are_half_open(spark):
    rows = [
        row(1, published=NOW, score=100.0),
        row(2, published=before(minutes=60), score=10.0),
        row(3, published=before(minutes=60, seconds=1), score=20.0),
        row(4, published=before(hours=24), score=30.0),
        row(5, published=before(hours=24, seconds=1), score=99.0),
        row(6, published=None, score=99.0),
        row(7, published=before(minutes=1), score=None),
        row(8, published=before(hours=-1), score=99.0),
        row(9, region="Nepali", published=before(hours=2), score=-40.0),
    ]
    got = by_feed(panels.rolling_sentiment(frame(spark, rows), NOW))
    assert got["International"] == {"feed": "International", "avg_24h": 20.0, "count_24h": 3, "avg_60m": 10.0, "count_60m": 1}
    assert got["Nepali"] == {"feed": "Nepali", "avg_24h": -40.0, "count_24h": 1, "avg_60m": None, "count_60m": 0}
    empty = by_feed(panels.rolling_sentiment(frame(spark, []), NOW))
    assert empty["Nepali"] == {"feed": "Nepali", "avg_24h": None, "count_24h": 0, "avg_60m": None, "count_60m": 0}


@pytest.mark.parametrize("size", [1, 3, 5, 6, 8, 50])
def test_newest_order_ties_and_nulls(spark, size):
    rows = [
        row(1, published=before(minutes=5)), row(2, published=before(minutes=5)), row(3, published=None), row(4, published=None),
        row(5, published=before(minutes=5, seconds=-20)), row(6, published=before(days=3)), row(7, published=before(minutes=-30)),
        row(8, region=None, published=before(minutes=5)), row(9, region="Nepali"),
    ]
    expected = [7, 5, 8, 2, 1, 6, 4, 3][:size]
    got = newest(frame(spark, rows), "International", size)
    assert [r.seq for r in got.collect()] == expected


def test_newest_bound_keeps_enough(spark):
    rows = [row(i, published=before(minutes=i // 4)) for i in range(40)]
    dated = frame(spark, rows)
    assert newest_bound(dated, 10) == datetime(2024, 1, 31, 12, 38)
    assert newest_bound(dated, 41) is None
    assert newest_bound(dated.where("false"), 1) is None


def test_newest_reads_recent_days_only(spark, tmp_path):
    rows = [row(i, published=before(days=i)) for i in range(10)]
    stored = frame(spark, rows).withColumns({"feed": F.lit("International"), "published_date": F.to_date("published_at")})
    stored.write.partitionBy("feed", "published_date").parquet(str(tmp_path / "s"))
    plan = newest(spark.read.parquet(str(tmp_path / "s")), "International", 3)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "feed#" in scan.split("PartitionFilters")[1] and "published_date#" in scan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(published_at" in scan and "TakeOrderedAndProject" in plan


def test_normalise_ragged_records(spark):
    rows = spark.createDataFrame(
        [(1, None, "", "12.5", "2024-01-02 03:04:05"), (2, "t", "Nepali", "n/a", "soon"), (3, "t", None, None, None)],
        "seq bigint, title string, region string, sentiment_score string, published_at string",
    )
    got = {r.seq: r.asDict() for r in normalise(rows).collect()}
    assert got[1] == {
        "seq": 1, "title": "", "region": "International", "sentiment_score": 12.5, "published_at": datetime(2024, 1, 2, 3, 4, 5),
        "link": "", "source": "", "sentiment": "", "text": "",
    }
    assert (got[2]["region"], got[2]["sentiment_score"], got[2]["published_at"]) == ("Nepali", None, None)
    assert got[3]["region"] == "International"


def test_mix_sources_and_coverage(spark):
    rows = frame(spark, [
        row(1, sentiment="Positive", source="a", text=" "), row(2, sentiment="Unscored", source="a", score=None),
        row(3, sentiment="Positive", source="b", score=20.0), row(4, sentiment="", source="c", score=None, text=None),
    ])
    assert [tuple(r) for r in panels.sentiment_mix(rows).collect()] == [("Positive", 2), ("", 1), ("Unscored", 1)]
    assert [tuple(r) for r in panels.source_counts(rows).collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert tuple(panels.coverage(rows).first()) == (4, 0.5, 0.5, 15.0)
    assert tuple(panels.coverage(rows.where("false")).first()) == (0, None, None, None)


def test_grid_fills_cells_and_follows_local_time(spark):
    rows = frame(spark, [
        row(1, sentiment="Positive", published=datetime(2024, 1, 31, 12, 14, 59, tzinfo=timezone.utc)),
        row(2, sentiment="Positive", published=datetime(2024, 1, 31, 12, 15, tzinfo=timezone.utc)),
        row(3, sentiment="Unscored"), row(4, sentiment="Negative", published=None), row(5, published=before(days=30)),
        row(6, sentiment="Negative", published=datetime(2024, 1, 30, 18, 14, 59, tzinfo=timezone.utc)),
    ])
    hourly = grids.sentiment_grid(rows, NOW, grids.HOURLY).collect()
    assert len(hourly) == 72
    counted = {(r.bucket, r.sentiment): r.stories for r in hourly if r.stories}
    assert counted == {
        (datetime(2024, 1, 31, 17), "Positive"): 1, (datetime(2024, 1, 31, 18), "Positive"): 1,
        (datetime(2024, 1, 30, 23), "Negative"): 1,
    }
    assert max(r.bucket for r in hourly) == datetime(2024, 1, 31, 18) and min(r.bucket for r in hourly) == datetime(2024, 1, 30, 19)
    assert {r.period for r in hourly if r.bucket == datetime(2024, 1, 31, 17)} == {"31 Jan 05 PM"}
    daily = grids.sentiment_grid(rows, NOW, grids.DAILY).collect()
    assert len(daily) == 21
    assert {(r.bucket, r.sentiment): r.stories for r in daily if r.stories} == {
        (datetime(2024, 1, 31), "Positive"): 2, (datetime(2024, 1, 30), "Negative"): 1,
    }
    assert {r.period for r in daily if r.bucket == datetime(2024, 1, 31)} == {"Wed 31 Jan"}
    assert {r.stories for r in grids.sentiment_grid(frame(spark, []), NOW, grids.DAILY).collect()} == {0}


def test_oldest_bucket_is_whole(spark):
    first_local_hour = datetime(2024, 1, 30, 13, 15, tzinfo=timezone.utc)  # 19:00 local, the first bucket
    got = grids.sentiment_grid(frame(spark, [row(1, published=first_local_hour)]), NOW, grids.HOURLY).where("stories > 0").collect()
    assert [(r.bucket, r.stories) for r in got] == [(datetime(2024, 1, 30, 19), 1)]
    first_local_day = datetime(2024, 1, 24, 18, 15, tzinfo=timezone.utc)  # 25 January local midnight
    got = grids.sentiment_grid(frame(spark, [row(1, published=first_local_day)]), NOW, grids.DAILY).where("stories > 0").collect()
    assert [(r.bucket, r.stories) for r in got] == [(datetime(2024, 1, 25), 1)]


def test_story_list(spark):
    rows = frame(spark, [row(1, title="", source=" ", link="mailto:x", sentiment="", score=None, published=None), row(2, sentiment="Positive")])
    got = [r.asDict() for r in panels.story_list(panels.sample(rows, "International")).collect()]
    assert got[0]["published"] == "31 Jan 2024 · 06:25 PM" and got[0]["label_class"] == "positive" and got[0]["link"] == "http://x"
    assert got[1] == {
        "seq": 1, "headline": "Untitled story", "source": "Unknown source", "label": "UNKNOWN", "label_class": "other",
        "published": "Published time unavailable", "link": None, "sentiment_score": None,
    }
    many = frame(spark, [row(i, published=before(minutes=i)) for i in range(40)])
    assert [r.seq for r in panels.story_list(panels.sample(many, "International")).collect()] == list(range(30))


def test_overview_and_texts(spark):
    rows = frame(spark, [row(1, published=before(minutes=5), score=12.34), row(2, region="Nepali", published=before(hours=3), score=-50.0, text="")])
    got = by_feed(panels.metric_texts(panels.overview(rows, NOW)))
    assert got["International"] == {
        "feed": "International", "avg_60m": "+12.3%", "avg_24h": "+12.3%", "rate": "0.0 records/min over 60 min",
        "text_coverage": "100%", "scoring_coverage": "100%", "mean_score": "+12.3%",
    }
    assert (got["Nepali"]["avg_60m"], got["Nepali"]["avg_24h"], got["Nepali"]["text_coverage"]) == ("—", "-50.0%", "0%")


def test_panels_scan_once_without_wide_columns(spark, tmp_path):
    frame(spark, [row(1)]).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for panel, columns in (
        (panels.region_counts(stored), "struct<region:string>"),
        (panels.ingest_rate(stored, NOW), "struct<region:string,ingested_at:timestamp>"),
        (panels.rolling_sentiment(stored, NOW), "struct<region:string,published_at:timestamp,sentiment_score:double>"),
    ):
        plan = panel._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and f"ReadSchema: {columns}" in plan, plan
        assert "Cartesian" not in plan
