"""Time parsing and local-time buckets. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickertone.schemas import LOCAL_ZONE

# Date formats of mail-style feed dates, week day removed.
MAIL_FORMATS = ("d MMM yyyy HH:mm[:ss][ ][z][xx]", "d MMM yy HH:mm[:ss][ ][z][xx]")


def iso_time(text: Column) -> Column:
    """ISO text to timestamp, null when it cannot be read."""
    return F.try_to_timestamp(text)


def feed_time(text: Column) -> Column:
    """ISO or mail-style (``Tue, 02 Jan 2024 10:00:00 +0545``) text to timestamp, else null."""
    # Pattern letter E is refused when parsing, so the week day is cut off first.
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    # Month names are read by their first three letters, whatever follows.
    bare = F.regexp_replace(bare, r"^(\d{1,2}\s+[A-Za-z]{3})[A-Za-z]*\.?", "$1")
    mail = [F.try_to_timestamp(bare, F.lit(fmt)) for fmt in MAIL_FORMATS]
    # A time of day alone would be read as of today.
    dated = F.when(F.trim(text).rlike(r"^\d{4}"), F.trim(text))
    return F.coalesce(iso_time(dated), *mail)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_bucket(ts: Column, unit: str, zone: str = LOCAL_ZONE) -> Column:
    """Start of the local hour or day; truncation follows the conversion, as +05:45 needs."""
    return F.date_trunc(unit, local_time(ts, zone))
