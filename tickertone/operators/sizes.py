"""Size checks that decide between a broadcast and a shuffle join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    The count stops at the bound. Beyond it the frame is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
