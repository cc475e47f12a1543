"""Index of titles already handled, for dedup across micro-batches and restarts.

One row per title and a hash of it. Each micro-batch adds a run, a folder named by the batch; when a
tier holds ``FAN`` runs, they are written together as one run of the next tier. So a title is
rewritten once a tier, and the runs there are grow with the logarithm of the titles. The rows of a
run are sorted by the hash, and Parquet keeps the bounds of its small pages: a lookup of few titles
reads the pages where their hashes would stand, however large the index has become.

An index is a set: a run that is there twice, or in part, changes no answer. So neither a replayed
batch nor a merge that stopped half way needs to be undone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickertone.operators.dedup import TITLE_KEY, title_keys
from tickertone.sources.folders import remove, subfolders

#: Runs of a tier that are merged into one of the next.
FAN = 8
#: Up to so many titles are looked up by their hashes; see ``spark.sql.parquet.pushdown.inFilterThreshold``.
LOOKUP_TITLES = 1_000
# Titles have no length limit, so both are checked.
BROADCAST_TITLES, BROADCAST_BYTES = 100_000, 20 * 1024 * 1024

_TITLES = T.StructType(
    [
        T.StructField("_hash", T.LongType()),
        T.StructField("_title", T.StringType()),
        T.StructField("_untitled", T.BooleanType()),
    ]
)
# Small pages and row groups, and no dictionary to read before them: a lookup touches a page a title.
# Bloom filters are left out: one is read whole for each row group met, which measured ten times the page.
_LAYOUT = {
    "parquet.page.row.count.limit": "200",
    "parquet.block.size": str(4 * 1024 * 1024),
    "parquet.enable.dictionary": "false",
}


def _hash() -> Column:
    return F.xxhash64(*TITLE_KEY)


class TitleIndex:
    """One writer at a time; a reader elsewhere that meets a merge tries again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        empty = spark.createDataFrame([], _TITLES)
        empty.write.mode("ignore").parquet(f"{path}/tier=0/run=start")

    def read(self) -> DataFrame:
        return self.spark.read.schema(_TITLES).parquet(self.path).select(*_TITLES.names)

    def runs(self, tier: int) -> list[str]:
        return [f"{self.path}/tier={tier}/{name}" for name in subfolders(self.spark, f"{self.path}/tier={tier}")]

    def _write(self, keys: DataFrame, tier: int, run: str) -> None:
        rows = keys.select(_hash().alias("_hash"), *TITLE_KEY).sortWithinPartitions("_hash")
        rows.write.mode("overwrite").options(**_LAYOUT).parquet(f"{self.path}/tier={tier}/run={run}")

    def add(self, batch: DataFrame, run: str | None = None) -> None:
        """Put the titles of a batch into the index; the run of a name is replaced."""
        self._write(title_keys(batch), 0, run or uuid.uuid4().hex)
        tier = 0
        while len(full := self.runs(tier)) >= FAN:
            rows = self.spark.read.schema(_TITLES).parquet(*full)
            self._write(rows.select(*TITLE_KEY).distinct(), tier + 1, uuid.uuid4().hex)
            for folder in full:
                remove(self.spark, folder)
            tier += 1

    def compact_to(self, path: str) -> TitleIndex:
        """A copy with one row per title in one run."""
        copy = TitleIndex(self.spark, path)
        copy._write(self.read().select(*TITLE_KEY).distinct(), 1, uuid.uuid4().hex)
        return copy

    def find(self, batch: DataFrame) -> DataFrame | None:
        """Title keys of the batch found in the index, None for a batch without rows.

        A few titles are looked up by their hashes, numbers that reach the scan as values to look for.
        More are broadcast up to a checked size, and joined by a shuffle beyond it; the index is never
        broadcast.
        """
        wanted = title_keys(batch).withColumn("_hash", _hash())
        size = wanted.agg(F.count("*").alias("titles"), F.sum(F.octet_length("_title")).alias("bytes")).first()
        if not size["titles"]:
            return None
        found = self.read()
        if size["titles"] <= LOOKUP_TITLES:
            hashes = [row["_hash"] for row in wanted.select("_hash").collect()]  # LOOKUP_TITLES numbers at most
            found = found.where(F.col("_hash").isin(hashes))
        few = size["titles"] <= BROADCAST_TITLES and (size["bytes"] or 0) <= BROADCAST_BYTES
        hits = found.join(F.broadcast(wanted) if few else wanted, ["_hash", *TITLE_KEY], "left_semi")
        return hits.select(*TITLE_KEY).distinct()
