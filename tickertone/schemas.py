"""Record layouts and the fixed values of the article contract."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Stored records and messages carry them, so they must not change.
# ---------------------------------------------------------------------------
NO_TITLE = "No Title Provided"
NO_LINK = "No Link Provided"
EXCERPT_CHARS = 6000

INTERNATIONAL = "International"
NEPALI = "Nepali"
LOCAL_ZONE = "Asia/Kathmandu"

LABELS = ("Positive", "Neutral", "Negative")
UNSCORED = "Unscored"
POSITIVE_FROM = 20
NEGATIVE_FROM = -20
SCORE_LIMIT = 100

HEADLINES_PER_REQUEST = 5
PRIMARY_MODEL = "@cf/meta/llama-3.1-8b-instruct"
FALLBACK_MODEL = "gemini-3.1-flash-lite"
NO_HEADLINE_MODEL = "unscored:no-headline@1"

SAMPLE_SIZE = 500
STORY_LIST_SIZE = 30
# ---------------------------------------------------------------------------

MESSAGE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("title", "text", "link", "source", "region", "published_at", "ingested_at")
    ]
)

ARTICLE = T.StructType(
    [
        T.StructField(f.name, T.TimestampType() if f.name.endswith("_at") else T.StringType())
        for f in MESSAGE.fields
    ]
)

ANALYSIS = T.StructType(
    [
        T.StructField("sentiment", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("sentiment_confidence", T.DoubleType()),
        T.StructField("sentiment_language", T.StringType()),
        T.StructField("sentiment_model", T.StringType()),
    ]
)

SCORED = T.StructType(ARTICLE.fields + ANALYSIS.fields)
