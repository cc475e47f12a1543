"""Regions, languages and labels of headlines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickertone.functions.text import strip
from tickertone.schemas import INTERNATIONAL, LABELS, NEGATIVE_FROM, NEPALI, POSITIVE_FROM

DEVANAGARI = "[\\u0900-\\u097F]"


def headline(title: Column) -> Column:
    """The text that is scored; empty when the title is null or blank."""
    return strip(F.coalesce(title, F.lit("")))


def region_key(region: Column) -> Column:
    """Grouping key of requests: stripped, null as empty, case kept."""
    return strip(F.coalesce(region, F.lit("")))


def is_nepali(region: Column) -> Column:
    return F.lower(region_key(region)) == NEPALI.lower()


def label(score: Column) -> Column:
    positive, neutral, negative = LABELS
    return (
        F.when(score >= POSITIVE_FROM, positive)
        .when(score <= NEGATIVE_FROM, negative)
        .when(score.isNotNull(), neutral)
    )


def language(text: Column, script: str = DEVANAGARI, inside: str = NEPALI, outside: str = "English") -> Column:
    """Language told by script: one character of the range is enough."""
    return F.when(F.coalesce(text, F.lit("")).rlike(script), inside).otherwise(outside)


def in_feed(region: Column, feed: str) -> Column:
    """Feed selection: records without a region belong to the international feed."""
    same = region == feed
    return (same | region.isNull()) if feed == INTERNATIONAL else same


def feed_of(region: Column) -> Column:
    """The feed a record is shown in; a region that is neither feed stays as it is."""
    return F.coalesce(region, F.lit(INTERNATIONAL))
