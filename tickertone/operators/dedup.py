"""Exact-title dedup inside a batch and against the store.

Titles compare raw and null-safe: null is one key, the empty string another. The key is kept as
two plain columns, so the dedup shuffle and the joins after it hash on the same columns and the
wide article rows move once.

``near`` names a column that the articles are spread by already, such as the key of the join that
made them. Narrow results of theirs are then sent to where the wide rows are (``session.use_placement``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TITLE_KEY = ["_title", "_untitled"]


def with_title_key(df: DataFrame) -> DataFrame:
    title = F.col("title")
    return df.withColumns({"_title": F.coalesce(title, F.lit("")), "_untitled": title.isNull()})


def title_keys(df: DataFrame) -> DataFrame:
    """Distinct title keys of a frame; partial aggregation folds copies before the shuffle."""
    return with_title_key(df.select("title")).select(*TITLE_KEY).distinct()


def sent_near(narrow: DataFrame, near: str) -> DataFrame:
    """Narrow rows spread as the wide rows are, to be joined with them where those stay.

    The hash join neither sorts the wide rows nor keeps them. A row without the column would find
    no wide row and is an error.
    """
    missing = F.raise_error(F.lit(f"a row has no {near}")).cast(narrow.schema[near].dataType)
    placed = narrow.withColumn(near, F.coalesce(near, missing))
    return placed.repartition(near).hint("shuffle_hash")


def _of_first_rows(articles: DataFrame, order: str, near: str) -> DataFrame:
    """The articles that have the place of a first one: those, and what ties with them.

    First ones are told from title, order and ``near`` by an aggregation that keeps a row per title, so no
    map task sorts its rows for it. A row without a number is the first, as in a window.
    """
    number, place = F.col(order), F.col(near)
    unnumbered = F.max(number.isNull())
    first = with_title_key(articles.select("title", order, near)).groupBy(*TITLE_KEY).agg(
        F.when(~unnumbered, F.min(number)).alias("_first"),
        F.when(unnumbered, F.max(F.when(number.isNull(), place))).otherwise(F.min_by(place, number)).alias(near),
    )
    there = sent_near(first.select("_first", near), near).withColumnRenamed(near, "_near")
    same = (F.col(near) == F.col("_near")) & F.col(order).eqNullSafe(F.col("_first"))
    return articles.join(there, same, "left_semi")


def keyed_first(articles: DataFrame, order: str | Column = "seq", near: str | None = None) -> DataFrame:
    """First row per title in arrival order, with its key columns.

    ``row_number() = 1`` becomes a group limit on both sides of the shuffle, so each map task
    sends at most one row per title however many copies it read. The limit sorts the rows of a
    map task; with ``near``, and ``order`` a column's name, only those that can be first reach it.
    """
    if near:
        articles = _of_first_rows(articles, order, near)
    arrival = Window.partitionBy(*TITLE_KEY).orderBy(order)
    return (
        with_title_key(articles)
        .withColumn("_rank", F.row_number().over(arrival))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def first_per_title(articles: DataFrame, order: str = "seq", near: str | None = None) -> DataFrame:
    return keyed_first(articles, order, near).drop(*TITLE_KEY)


def keyed_new(articles: DataFrame, stored: DataFrame, order: str = "seq", near: str | None = None) -> DataFrame:
    """First row per title not in ``stored``, with its key columns."""
    return keyed_first(articles, order, near).join(title_keys(stored), TITLE_KEY, "left_anti")


def new_articles(articles: DataFrame, stored: DataFrame, order: str = "seq", near: str | None = None) -> DataFrame:
    return keyed_new(articles, stored, order, near).drop(*TITLE_KEY)


def stored_hits(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Titles of the batch that the store already has, one row each.

    Distinct titles meet distinct titles, so copies on either side fold before they are shuffled.
    When the batch is small enough to broadcast, Catalyst moves the semi join below the distinct
    and the store is not shuffled at all.
    """
    hits = title_keys(stored).join(title_keys(batch), TITLE_KEY, "left_semi")
    return hits.select(F.when(~F.col("_untitled"), F.col("_title")).alias("title"))
