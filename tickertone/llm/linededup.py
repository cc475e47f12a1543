"""Removal of lines that stand on many sites.

Each line hash gets a HyperLogLog sketch of the sites that show it; sketches merge by aggregation,
first within each task. Lines whose estimate is near the threshold get an exact distinct count.
The document with the smallest id keeps the line, all others lose it. Only DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tickertone.llm.shared import sets_aside, written
from tickertone.llm.text import text_key

#: Sites from which on a line counts as boilerplate.
MIN_SITES = 8
#: log2 of a sketch's registers, and the standard errors that count as near.
SKETCH_BITS, NEAR = 12, 5
_BLANKS = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _occurrences(docs: DataFrame, *more: Column) -> DataFrame:
    """h1, h2 of each line that holds a word, white space at its ends left out."""
    line = F.btrim(F.col("line"), F.lit(_BLANKS))
    exploded = docs.select(*more, F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    keyed = exploded.withColumn("line", line).where(F.col("line") != "")
    return keyed.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}).drop("line")


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", site: str = "source") -> DataFrame:
    """h1, h2, home of each line on min_sites sites or more; home is the smallest document id.

    A null site counts as no site, a null id is never a home.
    """
    lines = _occurrences(docs, F.col(f"`{id_column}`").alias("id"), F.col(f"`{site}`").alias("site"))
    counted = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.min("id").alias("home"), F.count("site").alias("n")
    )
    error = NEAR * 1.04 / math.sqrt(1 << SKETCH_BITS)
    low, high = min(min_sites * (1 - error), min_sites - 1), max(min_sites * (1 + error), min_sites + 1)
    estimated = counted.where(F.col("n") >= min_sites).select("h1", "h2", "home", F.hll_sketch_estimate("sketch").alias("sites"))
    estimated = written(estimated.where(F.col("sites") >= low), small=True)
    near = estimated.where(F.col("sites") <= high)
    exact = (
        lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .where(F.col("site").isNotNull())
        .groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
        .select("h1", "h2")
    )
    near_kept = near.join(exact, ["h1", "h2"], "left_semi")
    return estimated.where(F.col("sites") > high).unionByName(near_kept).select("h1", "h2", "home")


@sets_aside(r"__.*|h1|h2|home|place|line")
def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", site: str = "source") -> DataFrame:
    """docs with text less its boilerplate lines, and n_lines and n_removed (columns of these names are replaced).

    Null and empty texts and lines without a word stay as they are. Each row gives one row; rows of
    one id and text are treated alike. The home document keeps each occurrence of its lines.
    """
    docs = docs.drop("n_lines", "n_removed")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, *[k.alias(f"__{n}") for k, n in zip(text_key(F.col("text")), ("t1", "t2"), strict=True)])
    spread = written(spread_lines(docs, min_sites, id_column, site), small=True)
    marked = _occurrences(
        docs, F.coalesce(F.col(f"`{id_column}`"), F.lit(0)).alias("__id"), F.col(f"`{id_column}`").isNull().alias("__none"), *[k.alias(f"__{k_}") for k, k_ in zip(text_key(F.col("text")), ("t1", "t2"), strict=True)]
    )
    gone = marked.join(spread, ["h1", "h2"]).where(F.col("__none") | (F.col("__id") != F.coalesce("home", F.lit(0))) | F.col("home").isNull())
    places = gone.groupBy("__id", "__none", "__t1", "__t2").agg(F.collect_set("place").alias("__gone"))
    keyed = keyed.withColumns({"__id": F.coalesce(F.col(f"`{id_column}`"), F.lit(0)), "__none": F.col(f"`{id_column}`").isNull()})
    joined = keyed.join(places.hint("shuffle_hash"), ["__id", "__none", "__t1", "__t2"], "left")
    lines = _lines(F.col("text"))
    # array_except works by hash: linear in the lines, also where most of them go.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    cleaned = F.array_join(F.transform(F.array(lines), lambda all_: F.transform(left, lambda i: F.get(all_, i)))[0], "\n")
    return joined.select(
        *[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(cleaned).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
