"""Feed registry: which source and region a feed address stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REGISTRY = "url string, source string, region string"

# The configured feeds, in polling order.
FEEDS = [
    ("https://feeds.bbci.co.uk/news/rss.xml", "BBC", "International"),
    ("https://www.onlinekhabar.com/feed", "Onlinekhabar", "Nepali"),
    ("https://www.cbsnews.com/latest/rss/main", "CBS", "International"),
    ("https://www.setopati.com/feed", "Setopati", "Nepali"),
    ("https://rss.nytimes.com/services/xml/rss/nyt/HomePage.xml", "NY Times", "International"),
    ("https://nepalnews.com/feed", "Nepal News", "Nepali"),
    ("https://news.google.com/rss?hl=en-US&gl=US&ceid=US:en", "Google News", "International"),
    ("https://www.ratopati.com/feed", "Ratopati", "Nepali"),
    ("https://feeds.npr.org/1003/rss.xml", "NPR", "International"),
    ("https://www.nepalpress.com/feed/", "Nepal Press", "Nepali"),
    ("https://www.theguardian.com/world/rss", "The Guardian", "International"),
    ("https://www.thehimalayantimes.com/rssFeed/15", "The Himalayan Times", "Nepali"),
    ("https://www.aljazeera.com/xml/rss/all.xml", "Al Jazeera", "International"),
    ("https://kathmandupost.com/rss/", "The Kathmandu Post", "Nepali"),
    ("https://rss.dw.com/rdf/rss-en-all", "DW", "International"),
    ("https://www.france24.com/en/rss", "France 24", "International"),
    ("https://www.cnbc.com/id/100003114/device/rss/rss.html", "CNBC", "International"),
    ("https://feeds.nbcnews.com/nbcnews/public/news", "NBC News", "International"),
    ("https://abcnews.go.com/abcnews/topstories", "ABC News", "International"),
]


def default_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEEDS, REGISTRY)


def read_registry(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A registry kept as a table of url, source and region."""
    reader = spark.read.schema(REGISTRY).format(fmt)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(path)


def count_by_region(registry: DataFrame) -> DataFrame:
    return registry.groupBy("region").agg(F.count("*").alias("feeds"))
