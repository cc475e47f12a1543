"""Arrival numbers of micro-batch rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A number holds the batch above and the row below: 2^31 batches of up to 2^32 rows each.
ROW_BITS = 32
_TASK_BITS = 33  # Spark's own row numbers hold the task above these bits


def with_arrival(batch: DataFrame, batch_id: int) -> DataFrame:
    """Arrival number of sources that have none: batch, then a dense number by task and row.

    The rows of a task are the same files in the same order whenever the task runs again. Row
    counts of the tasks, one narrow row each, are added up first, so numbers depend neither on
    how many tasks there are nor on gaps between them.
    """
    if "seq" in batch.columns:
        return batch
    if batch_id >> (63 - ROW_BITS):
        raise ValueError(f"batch {batch_id} has no room in an arrival number")
    own = F.monotonically_increasing_id()
    numbered = batch.withColumn("_own", own).withColumn("_task", F.shiftright("_own", _TASK_BITS))
    sizes = numbered.groupBy("_task").agg(F.count("*").alias("n")).collect()  # one row per task
    before, total = {}, 0
    for row in sorted(sizes, key=lambda r: r["_task"]):
        before[row["_task"]] = total
        total += row["n"]
    if total >> ROW_BITS:
        raise ValueError(f"{total} rows in one micro-batch have no room in an arrival number")
    starts = batch.sparkSession.createDataFrame(list(before.items()), "_task bigint, _before bigint")
    row = F.col("_own") - F.shiftleft("_task", _TASK_BITS)
    seq = F.lit(batch_id << ROW_BITS).cast("long") + F.col("_before") + row
    return numbered.join(F.broadcast(starts), "_task").withColumn("seq", seq).drop("_own", "_task", "_before")
