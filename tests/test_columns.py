from datetime import datetime

from pyspark.sql import functions as F

from tickertone.functions.times import feed_time
from tickertone.functions import display, sentiment as se, times as ti


def column(spark, kind, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_feed_times(spark):
    values = [
        "2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 03:04:05 GMT", "Tue, 02 Jan 2024 08:49:05 +0545",
        "2 Jan 2024 03:04 +0000", "Tuesday, 02 Jan 24 03:04:05 GMT", "2024-01-02T03:04:05+05:45", "garbage", "", None,
    ]
    at = datetime(2024, 1, 2, 3, 4, 5)
    expected = [at, at, at, at.replace(second=0), at, datetime(2024, 1, 1, 21, 19, 5), None, None, None]
    assert column(spark, "string", values, ti.feed_time) == expected


def test_unreadable_iso_time_is_null(spark):
    assert column(spark, "string", ["garbage", None, "2024-13-01"], ti.iso_time) == [None, None, None]


def test_local_buckets_follow_the_offset(spark):
    values = [datetime(2024, 1, 1, 18, 14, 59), datetime(2024, 1, 1, 18, 15)]
    assert column(spark, "timestamp", values, lambda c: ti.local_bucket(c, "hour")) == [
        datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 0),
    ]
    assert column(spark, "timestamp", values, lambda c: ti.local_bucket(c, "day")) == [
        datetime(2024, 1, 1), datetime(2024, 1, 2),
    ]


def test_labels_at_their_edges(spark):
    scores = [-100, -20, -19, 0, 19, 20, 100, None]
    assert column(spark, "int", scores, se.label) == [
        "Negative", "Negative", "Neutral", "Neutral", "Neutral", "Positive", "Positive", None,
    ]


def test_language_by_script(spark):
    values = ["Budget talks", "नयाँ", "Nepal ma नयाँ yojana", "naya yojana", "", None]
    assert column(spark, "string", values, se.language) == ["English", "Nepali", "Nepali", "English", "English", "English"]


def test_regions(spark):
    values = ["Nepali", " nepali ", "NEPALI", "International", "", None]
    assert column(spark, "string", values, se.is_nepali) == [True, True, True, False, False, False]
    assert column(spark, "string", values, se.region_key) == ["Nepali", "nepali", "NEPALI", "International", "", ""]
    assert column(spark, "string", values, lambda c: F.coalesce(se.in_feed(c, "International"), F.lit(False))) == [
        False, False, False, True, False, True,
    ]
    assert column(spark, "string", values, lambda c: F.coalesce(se.in_feed(c, "Nepali"), F.lit(False))) == [
        True, False, False, False, False, False,
    ]


def test_display_texts(spark):
    assert column(spark, "string", ["", None, "t"], display.shown_title) == ["Untitled story", "Untitled story", "t"]
    assert column(spark, "string", [" ", None, " BBC "], display.shown_source) == ["Unknown source", "Unknown source", "BBC"]
    assert column(spark, "string", ["Positive", "", None, "Unscored"], display.shown_label) == ["POSITIVE", "UNKNOWN", "UNKNOWN", "UNSCORED"]
    assert column(spark, "string", ["Positive", "", None, "Unscored"], display.label_class) == ["positive", "other", "other", "other"]
    assert column(spark, "double", [12.34, -5.0, 0.0, None], display.signed_percent) == ["+12.3%", "-5.0%", "+0.0%", "—"]
    assert column(spark, "double", [0.798, 1.0, None], display.whole_percent) == ["80%", "100%", "—"]
    assert column(spark, "double", [0.25, 0.75, -0.25], display.signed_percent) == ["+0.2%", "+0.8%", "-0.2%"]
    assert column(spark, "double", [0.125, 0.005, 0.015], display.whole_percent) == ["12%", "0%", "2%"]
    assert column(spark, "timestamp", [datetime(2024, 1, 31, 18, 15), None], display.shown_time) == [
        "01 Feb 2024 · 12:00 AM", "Published time unavailable",
    ]


def test_feed_times_need_a_date(spark):
    texts = ["10:00", "02 January 2024 10:00:00 GMT", "Mon, 02 Sept 2024 10:00:00 +0545", "2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 10:00 GMT", "soon", None]
    got = column(spark, "string", texts, feed_time)
    assert got == [None, datetime(2024, 1, 2, 10), datetime(2024, 9, 2, 4, 15), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 10), None, None]
