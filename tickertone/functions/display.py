"""Display fallbacks and text forms of the story list and metric tiles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickertone.functions.text import is_web_link, strip
from tickertone.functions.times import local_time
from tickertone.schemas import LABELS

# Texts and date patterns shown to readers.
UNTITLED = "Untitled story"
UNKNOWN_SOURCE = "Unknown source"
UNKNOWN_LABEL = "UNKNOWN"
UNKNOWN_TIME = "Published time unavailable"
NO_VALUE = "—"
HOUR_LABEL = "dd MMM hh a"
DAY_LABEL = "E dd MMM"
STORY_TIME = "dd MMM yyyy · hh:mm a"


def _or(text: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


def shown_title(title: Column) -> Column:
    return _or(title, UNTITLED)


def shown_source(source: Column) -> Column:
    return _or(strip(source), UNKNOWN_SOURCE)


def shown_label(sentiment: Column) -> Column:
    return _or(F.upper(sentiment), UNKNOWN_LABEL)


def label_class(sentiment: Column) -> Column:
    lowered = F.lower(F.coalesce(sentiment, F.lit("")))
    return F.when(lowered.isin([name.lower() for name in LABELS]), lowered).otherwise("other")


def shown_time(published_at: Column) -> Column:
    return F.coalesce(F.date_format(local_time(published_at), STORY_TIME), F.lit(UNKNOWN_TIME))


def shown_link(link: Column) -> Column:
    return F.when(is_web_link(link), link)


def signed_percent(value: Column) -> Column:
    """One digit after the point, ties to the even digit."""
    return F.when(value.isNotNull(), F.format_string("%+.1f%%", F.bround(value, 1))).otherwise(NO_VALUE)


def whole_percent(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.0f%%", F.bround(share * 100, 0))).otherwise(NO_VALUE)
