"""Request batches: at most five headlines of one region, in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickertone.functions.sentiment import headline, region_key
from tickertone.schemas import HEADLINES_PER_REQUEST

# 262,144 arrival numbers per block: the most rows one task ever numbers.
BLOCK_BITS = 18
# Block counts are added up in groups of 8,388,608 block numbers: with BLOCK_BITS, two levels cover 64 bits.
LEVEL_BITS = 23


def _rows_before(counts: DataFrame, key: str, bits: int, level_bits: int) -> DataFrame:
    """Adds ``_before``, the rows of the key in earlier blocks, to the counts of blocks that have ``bits`` bits.

    While the block numbers have more than ``level_bits`` bits, their upper bits name groups of
    blocks: earlier groups are counted by the same rule, earlier blocks of the group in a window.
    So no window holds more than one group, however sparse the numbers.
    """
    if bits <= level_bits:
        earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    grouped = counts.withColumn("_group", F.shiftright("_block", level_bits))
    groups = grouped.groupBy(key, F.col("_group").alias("_block")).agg(F.sum("count").alias("count"))
    above = _rows_before(groups, key, bits - level_bits, level_bits).select(
        key, F.col("_block").alias("_group"), F.col("_before").alias("_above")
    )
    earlier = Window.partitionBy(key, "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = grouped.withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    return inside.join(above, [key, "_group"]).select(
        key, "_block", "count", (F.col("_before") + F.col("_above")).alias("_before")
    )


def number_rows(
    rows: DataFrame, key: str, order: str = "seq", block_bits: int = BLOCK_BITS, level_bits: int = LEVEL_BITS
) -> DataFrame:
    """Exact 0-based position of each row inside its key, as column ``position``.

    There are only a few regions, so a window per region would be a few tasks. ``order`` is a
    unique integer, so it is cut into blocks of equal width: a (key, block) group holds at most
    one block of rows however hot the key is. Rows are numbered inside their block and moved up
    by the count of the blocks before, which a prefix sum over levels of blocks gives. Blocks depend
    on values alone, so a task that runs again numbers its rows the same way. A row without a
    number has no place and is an error.
    """
    missing = F.raise_error(F.lit(f"a row has no {order}")).cast("bigint")
    blocked = rows.withColumn("_block", F.coalesce(F.shiftright(order, block_bits), missing))
    counts = blocked.groupBy(key, "_block").count()
    offsets = _rows_before(counts, key, 64 - block_bits, level_bits).select(key, "_block", "_before")
    inside = Window.partitionBy(key, "_block").orderBy(order)
    return (
        blocked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [key, "_block"])
        .withColumn("position", F.col("_before") + F.col("_inside") - 1)
        .drop("_block", "_before", "_inside")
    )


def pending_headlines(articles: DataFrame, order: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """The narrow rows that need a score: arrival number, region key and stripped headline."""
    return articles.select(
        order,
        *keep,
        region_key(F.col("region")).alias("region_key"),
        headline(F.col("title")).alias("headline"),
    ).where(F.col("headline") != "")


def assign_batches(
    pending: DataFrame,
    order: str = "seq",
    size: int = HEADLINES_PER_REQUEST,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Batch number inside the region and 1-based item id inside the batch."""
    numbered = number_rows(pending, "region_key", order, block_bits)
    return numbered.select(
        *pending.columns,
        F.expr(f"position div {size}").alias("batch_no"),
        (F.col("position") % size + 1).cast("int").alias("item_id"),
    )


def form_requests(assigned: DataFrame, key: str = "seq", near: str | None = None) -> DataFrame:
    """One row per request: region, batch number, keys and headlines of its articles in order.

    A group never holds more than one request, so no list can grow. ``near`` is listed as the key is.
    """
    extra = [near] if near else []
    items = F.sort_array(F.collect_list(F.struct("item_id", F.col(key).alias("key"), "headline", *extra)))
    return (
        assigned.groupBy("region_key", "batch_no")
        .agg(items.alias("items"))
        .select(
            "region_key",
            "batch_no",
            F.col("items.key").alias(f"{key}s"),
            F.col("items.headline").alias("headlines"),
            *[F.col(f"items.{name}").alias(f"{name}s") for name in extra],
        )
    )
