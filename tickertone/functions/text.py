"""Text cleaning on the JVM; Python is asked only for entities the JVM path cannot decode."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The Unicode white space that text stripping and collapsing recognise.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Entities decoded without leaving the JVM. ``&amp;`` comes last, so ``&amp;lt;`` decodes once.
NATIVE_ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "#39": "'",
    "nbsp": "\xa0",
    "middot": "\xb7",
    "copy": "\xa9",
    "amp": "&",
}
# An ampersand that starts none of them.
_HARD_ENTITY = "&(?!(?:" + "|".join(NATIVE_ENTITIES) + ");)"
# The same set as WHITESPACE. A class that spells out the wide characters is tested one by one
# for every letter and takes five times as long.
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """Trim Unicode white space; ``trim`` alone only knows the plain space."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return strip(F.coalesce(text, F.lit(""))) == ""


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, _SPACE_RUN, " "))


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", " ")


def _native_unescape(text: Column) -> Column:
    decoded = text
    for name, char in NATIVE_ENTITIES.items():
        decoded = F.replace(decoded, F.lit(f"&{name};"), F.lit(char))
    return F.when(text.contains("&"), decoded).otherwise(text)


def _needs_python(text: Column) -> Column:
    """True when an entity outside the tags is beyond the JVM path; most text fails the first test."""
    return text.rlike(_HARD_ENTITY) & drop_tags(text).rlike(_HARD_ENTITY)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_blocks(blocks: pd.Series) -> pd.Series:
    return blocks.map(
        lambda row: None if row is None else [None if v is None else html.unescape(v) for v in row]
    )


def clean_blocks(blocks: Column) -> Column:
    """Markup out, entities decoded, white space collapsed, for each block of an array.

    Tags go before entities are decoded, so escaped markup stays as text. Rows the JVM can decode
    alone reach Python as nulls, so their text is not shipped.
    """
    hard = F.when(F.exists(blocks, _needs_python), F.transform(blocks, drop_tags))
    decoded = F.coalesce(
        _unescape_blocks(hard), F.transform(blocks, lambda b: _native_unescape(drop_tags(b)))
    )
    return F.transform(decoded, collapse)


def clean_text(value: Column) -> Column:
    """Clean one markup string; null gives an empty string."""
    return clean_blocks(F.array(F.coalesce(value, F.lit(""))))[0]


def excerpt(content: Column, summary: Column, description: Column, limit: int) -> Column:
    """First content block with text after cleaning, else summary, else description, capped."""
    summarised = F.when(summary != "", summary).otherwise(F.coalesce(description, F.lit("")))
    blocks = F.concat(F.coalesce(content, F.array().cast("array<string>")), F.array(summarised))
    kept = F.filter(clean_blocks(F.transform(blocks, lambda b: F.coalesce(b, F.lit("")))), lambda b: b != "")
    return F.substring(F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit("")), 1, limit)


def is_web_link(link: Column) -> Column:
    return F.coalesce(link.rlike("^https?://"), F.lit(False))
