"""Article messages: JSON in a topic, or in files where there is no broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertone.functions.times import iso_text, iso_time
from tickertone.schemas import MESSAGE

TOPIC = "news_topic"
OFFSET_BITS = 48

# Messages repeat names and words, so files of them are compressed. Small row groups keep a file
# readable in parts, which compressed text is not.
_PACKED = {"compression": "zstd", "parquet.block.size": str(16 * 1024 * 1024)}


def read_topic(
    spark: SparkSession,
    servers: str,
    topic: str = TOPIC,
    max_offsets: int | None = None,
    starting: str = "earliest",
) -> DataFrame:
    """Topic as a stream of ``seq, value``; partition and offset make the arrival number."""
    source = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_offsets:
        source = source.option("maxOffsetsPerTrigger", max_offsets)
    arrival = F.shiftleft(F.col("partition").cast("long"), OFFSET_BITS) + F.col("offset")
    return source.load().select(arrival.alias("seq"), "value")


def read_topic_files(spark: SparkSession, path: str, max_files: int | None = None, packed: bool = False) -> DataFrame:
    """Stand-in for the topic: a growing folder of text files, one message per line.

    ``packed`` files are Parquet, one message per row.
    """
    source = spark.readStream.schema("value string").format("parquet" if packed else "text")
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    return source.load(path).select("value")


def encode_messages(articles: DataFrame) -> DataFrame:
    """One JSON ``value`` per article; null fields are written as null."""
    fields = [
        (iso_text(F.col(f.name)) if f.name.endswith("_at") else F.col(f.name)).alias(f.name)
        for f in MESSAGE.fields
    ]
    return articles.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def decode_messages(raw: DataFrame) -> DataFrame:
    """Messages to typed articles, other columns kept.

    Bad JSON gives a record of nulls; unreadable times are null.
    """
    keep = [c for c in raw.columns if c != "value"]
    data = F.from_json(F.col("value").cast("string"), MESSAGE)
    flat = raw.select(*keep, data.alias("data")).select(*keep, "data.*")
    return flat.withColumns({c: iso_time(F.col(c)) for c in ("published_at", "ingested_at")})


def write_topic(messages: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Publish a batch of ``value`` rows without keys."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_topic_files(messages: DataFrame, path: str, packed: bool = False) -> None:
    """Publish a batch to the folder that stands in for the topic."""
    to = messages.write.mode("append")
    to.options(**_PACKED).parquet(path) if packed else to.text(path)
