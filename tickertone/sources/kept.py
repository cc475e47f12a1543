"""Tables that micro-batches keep up to date for the panels: counts by minute, and the newest articles.

``counts`` holds mergeable partials (stories, scored stories, sum of scores). They are kept by minute
of publishing with feed and label, by minute of ingestion with feed, and in total by feed; hours,
days and rolling windows are sums of minutes. A batch reads and rewrites the days its articles fall
on, a day being at most 1,440 minutes by feeds and labels, so neither a batch nor a panel reads more
as the store grows. Each day knows the last batch that is in it: a batch that runs again changes only
the days it did not reach.

``newest`` holds the newest articles of each feed. They are found among those kept and those of the
batch, and an article that comes again is still one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tickertone.functions.sentiment import feed_of
from tickertone.operators.samples import SAMPLE_FIELDS
from tickertone.schemas import INTERNATIONAL, NEPALI, SAMPLE_SIZE, SCORED

PUBLISHED, INGESTED, TOTAL = "published", "ingested", "total"
_KEYS = ("kind", "day", "feed", "sentiment", "minute")
_COUNTS = (
    "kind string, feed string, sentiment string, minute timestamp, stories bigint, scored bigint, score_sum double, "
    "stream string, number bigint, day date"
)
_NEWEST = T.StructType(
    [T.StructField("seq", T.LongType()), *[SCORED[name] for name in SAMPLE_FIELDS], T.StructField("feed", T.StringType())]
)


def partials(scored: DataFrame) -> DataFrame:
    """kind, day, feed, sentiment, minute with stories, scored, score_sum of some articles.

    Articles without a publish time are in no publish minute, those without an ingest time in a
    minute of null. Partial aggregation folds them before the shuffle.
    """

    def entry(kind: str, minute, label):
        return F.struct(F.lit(kind).alias("kind"), F.to_date(minute).alias("day"), label.alias("sentiment"), minute.alias("minute"))

    none, never = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    published, ingested = F.date_trunc("minute", "published_at"), F.date_trunc("minute", "ingested_at")
    entries = F.array(entry(PUBLISHED, published, F.col("sentiment")), entry(INGESTED, ingested, none), entry(TOTAL, never, none))
    rows = scored.select(feed_of(F.col("region")).alias("feed"), "sentiment_score", F.explode(entries).alias("e"))
    rows = rows.select("e.*", "feed", "sentiment_score").where((F.col("kind") != PUBLISHED) | F.col("minute").isNotNull())
    score = F.col("sentiment_score")
    return rows.groupBy(*_KEYS).agg(F.count("*").alias("stories"), F.count(score).alias("scored"), F.coalesce(F.sum(score), F.lit(0.0)).alias("score_sum"))


class KeptCounts:
    """One writer at a time, its batches in order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], _COUNTS).write.mode("ignore").partitionBy("day").parquet(path)

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(_COUNTS).parquet(self.path).where(F.col("kind") == kind)

    def fold(self, scored: DataFrame, stream: str, number: int) -> None:
        """Add the articles of a batch, once for a stream's batch number however often it runs."""
        new = partials(scored).persist()
        try:
            days = [row.day for row in new.select("day").distinct().collect()]  # the days of one batch
            if not days:
                return
            touched = F.coalesce(F.col("day").isin([d for d in days if d is not None]), F.lit(False))
            if None in days:
                touched |= F.col("day").isNull()
            kept = self.spark.read.schema(_COUNTS).parquet(self.path).where(touched)
            # The days that have the batch already.
            done = kept.where((F.col("stream") == stream) & (F.col("number") >= number)).select(F.col("day").alias("_done")).distinct()
            both = kept.select(*new.columns).unionByName(new).join(done, F.col("day").eqNullSafe(F.col("_done")), "left_anti")
            summed = both.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in ("stories", "scored", "score_sum")])
            marked = summed.withColumns({"stream": F.lit(stream), "number": F.lit(number).cast("long")})
            (
                # A day is small and has one file.
                marked.repartition("day")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("day")
                .parquet(self.path)
            )
        finally:
            new.unpersist()


class KeptNewest:
    def __init__(self, spark: SparkSession, path: str, size: int = SAMPLE_SIZE):
        self.spark, self.path, self.size = spark, path, size
        spark.createDataFrame([], _NEWEST).write.mode("ignore").partitionBy("feed").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(_NEWEST).parquet(self.path)

    def fold(self, scored: DataFrame) -> None:
        """Let the articles of a batch take their places: publish time descending, nulls last, later arrivals first.

        The rank limit holds on both sides of the shuffle, so a task sends at most ``size`` rows a feed.
        """
        new = scored.withColumn("feed", feed_of(F.col("region"))).where(F.col("feed").isin(INTERNATIONAL, NEPALI))
        rows = self.read().unionByName(new.select(*_NEWEST.names))
        # An article that comes again has the place that it had, so it pushes none out.
        order = Window.partitionBy("feed").orderBy(F.col("published_at").desc_nulls_last(), F.col("seq").desc())
        first = rows.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= self.size).drop("_rank")
        kept = first.dropDuplicates(["feed", "seq"]).repartition("feed")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed").parquet(self.path)
