"""Article, store and feed views over the test tables, read as Spark frames.

Events give time and volume, documents give headline, text, source and language.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickertone.functions.sentiment import headline, label
from tickertone.operators.batching import assign_batches, form_requests, pending_headlines
from tickertone.operators.dedup import new_articles
from tickertone.schemas import UNSCORED
from tickertone.session import use_utc
from tickertone.sources.registry import FEEDS

STORE_HOURS = 708  # the store holds what came in longer than this before the clock


# Stated, so that reading a table starts no job to look at its footers.
LAYOUTS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.schema(LAYOUTS[name]).parquet(f"{sf_dir}/{name}.parquet")


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The clock: five minutes after the last event (one value, from a column-pruned scan)."""
    last = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return last.astimezone(timezone.utc) + timedelta(minutes=5)


def articles(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep=("d_id",)`` leaves the column that the rows are spread by."""
    documents = table(spark, sf_dir, "documents")
    total = documents.count()
    # Cut the text before the join, so only the columns a query uses are shuffled.
    docs = documents.select(
        F.col("doc_id").alias("d_id"),
        F.substring_index("text", "\n", 1).alias("headline"),
        F.substring("text", 1, 6000).alias("excerpt"),
        "source",
        F.when(F.col("lang") == "en", "International")
        .when(F.col("lang") != "de", "Nepali")
        .alias("region"),
    )
    # The join's own shuffle when both sides are large. When one is broadcast it still spreads the
    # documents, whose few large row groups would otherwise be all the tasks there are.
    docs = docs.repartition("d_id")
    events = table(spark, sf_dir, "events").withColumn("d_id", F.col("event_id") % total)
    seq, kind, at = F.col("event_id"), F.col("event_type"), F.col("ts").cast("timestamp")
    return events.join(docs, "d_id").select(
        *keep,
        seq.alias("seq"),
        F.when(seq % 97 == 0, F.lit(None))
        .when(F.col("value") < 1, " ")
        .otherwise(F.col("headline"))
        .alias("title"),
        F.when(kind == "signup", "").otherwise(F.col("excerpt")).alias("text"),
        F.when(seq % 11 == 0, "No Link Provided")
        .otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), seq.cast("string")))
        .alias("link"),
        "source",
        "region",
        F.when(kind != "error", at).alias("published_at"),
        (at + F.expr("INTERVAL 5 MINUTES")).alias("ingested_at"),
    )


def stored_articles(rows: DataFrame, clock: datetime) -> DataFrame:
    """The part of the stream the store already holds."""
    return rows.where(F.col("ingested_at") < F.lit(clock - timedelta(hours=STORE_HOURS)))


def arriving_articles(rows: DataFrame, clock: datetime) -> DataFrame:
    return rows.where(F.col("ingested_at") >= F.lit(clock - timedelta(hours=STORE_HOURS)))


def fixture_score(text: Column) -> Column:
    """The score of ``workload.scorer.fixture_scorer`` as a column."""
    letters = F.length(text) - F.length(F.replace(text, F.lit("e"), F.lit("")))
    return (F.length(text) * 37 + letters * 53) % 201 - 100


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles as the store holds them, the scorer being the arithmetic one."""
    text = headline(F.col("title"))
    score = F.when(text != "", fixture_score(text))
    return articles(spark, sf_dir).withColumns(
        {"sentiment_score": score.cast("double"), "sentiment": F.coalesce(label(score), F.lit(UNSCORED))}
    )


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files made from documents: twenty entries each, RSS and Atom in turn.

    Every fifth one is followed by stray markup, Spanish entries have no title, and every ninth
    entry has an address that is not on the web.
    """

    def escaped(text: Column) -> Column:
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(name))
        return text

    def element(name: str, text: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))

    doc = F.col("doc_id")
    address = F.concat(
        F.when(doc % 9 == 0, "urn:doc:").otherwise("https://feeds.example/"), doc.cast("string")
    )
    title = F.when(
        F.col("lang") != "es", element("title", escaped(F.substring_index("text", "\n", 1)))
    ).otherwise("")
    rss = F.concat(
        F.lit("<item>"), title, element("link", address), element("description", escaped(F.col("text"))),
        F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry>"), title, F.lit('<link rel="alternate" href="'), address, F.lit('"/>'),
        element("summary", escaped(F.col("text"))), F.lit("</entry>"),
    )
    feed_no = F.floor(doc / 20).cast("long")
    is_atom = F.col("feed_no") % 2 == 1
    entries = table(spark, sf_dir, "documents").select(
        feed_no.alias("feed_no"), doc.alias("doc_id"), F.when(feed_no % 2 == 1, atom).otherwise(rss).alias("entry")
    )
    body = F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", "entry")))["entry"], "")
    feeds = entries.groupBy("feed_no").agg(body.alias("body"))
    return feeds.select(
        F.concat(F.lit("https://feeds.example/"), F.col("feed_no").cast("string")).alias("url"),
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
            F.when(is_atom, '<feed xmlns="http://www.w3.org/2005/Atom">').otherwise('<rss version="2.0"><channel>'),
            F.col("body"),
            F.when(is_atom, "</feed>").otherwise("</channel></rss>"),
            F.when(F.col("feed_no") % 5 == 0, "<script>track(0);</script>").otherwise(""),
        ).alias("document"),
    )


def damaged_feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed documents as bytes, some damaged by the number of the feed.

    Modulo seven: 1 begins with an entry that is never closed, 2 ends with an entry whose title holds
    its own closing tag as character data, 3 holds a byte that is not UTF-8, 4 is empty.
    """
    feed_no = F.element_at(F.split("url", "/"), -1).cast("long")
    kind = feed_no % 7
    is_atom = feed_no % 2 == 1
    name = F.when(is_atom, "entry").otherwise("item")
    link = F.when(is_atom, '<link href="https://x.example/1"/>').otherwise("<link>https://x.example/1</link>")
    opening = F.when(is_atom, '<feed xmlns="http://www.w3.org/2005/Atom">').otherwise('<rss version="2.0"><channel>')
    closing = F.when(is_atom, "</feed>").otherwise("</channel></rss>")
    unclosed = F.concat(opening, F.lit("<"), name, F.lit("><title>cut off</title>"))
    closed = F.concat(F.lit("<"), name, F.lit("><title><![CDATA[a </"), name, F.lit("> b]]></title>"), link, F.lit("</"), name, F.lit(">"), closing)
    text = F.when(kind == 1, F.replace("document", opening, unclosed)).when(kind == 2, F.replace("document", closing, closed)).otherwise(F.col("document"))
    content = F.encode(text, "UTF-8")
    # The byte follows the opening, so it stands in no entry.
    head = F.encode(F.call_function("substring_index", F.col("document"), opening, F.lit(1)), "UTF-8")
    rest = F.encode(F.concat(opening, F.call_function("substring_index", F.col("document"), opening, F.lit(-1))), "UTF-8")
    cut = F.length(F.encode(opening, "UTF-8"))
    damaged = F.concat(head, F.substring(rest, F.lit(1), cut), F.unhex(F.lit("E9")), F.substring(rest, cut + 1, F.length(rest)))
    content = F.when(kind == 3, damaged).when(kind == 4, F.encode(F.lit(""), "UTF-8")).otherwise(content)
    return feed_documents(spark, sf_dir).select("url", content.alias("content"))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries made from web pages, their markup in the content, summary or description.

    Pages go to the registered feeds in turn; some have no title, dates are mail-style or ISO.
    """
    page = F.col("page_id")
    feeds = F.array(*[F.lit(url) for url, _, _ in FEEDS])
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=(page % 1000).cast("int"))
    kind = page % 4
    html = F.col("html")
    return table(spark, sf_dir, "pages").withColumnRenamed("url", "page_url").select(
        "page_id",
        F.element_at(feeds, (page % len(FEEDS) + 1).cast("int")).alias("url"),
        F.when(page % 10 != 7, F.concat(F.lit("\t "), F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("title"),
        F.when(page % 6 != 5, F.col("page_url")).alias("link"),
        F.when(kind == 0, F.array(F.lit("<p>&nbsp;</p>"), html)).alias("content"),
        F.when(kind == 1, html).when(kind == 2, "").alias("summary"),
        F.when(kind == 2, html).alias("description"),
        F.when(page % 3 == 0, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(page % 3 == 1, "sometime")
        .alias("published"),
        F.when(page % 3 != 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:45"))).alias("updated"),
    )


# One fault per variant number; 0 and 1 are sound, and 3 is sound for a single headline.
RESPONSE_VARIANTS = 14


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = as_of(spark, sf_dir)
    rows = articles(spark, sf_dir)
    fresh = new_articles(arriving_articles(rows, clock), stored_articles(rows, clock))
    return form_requests(assign_batches(pending_headlines(fresh)))


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the generated body of a provider, sound or with one kind of fault."""
    variant = F.col("variant")

    def item(text: Column, i: Column) -> Column:
        number = F.when(variant == 3, 1).when(variant == 4, i).otherwise(i + 1).cast("string")
        score = (
            F.when(variant == 5, "101")
            .when(variant == 6, "10.5")
            .when(variant == 7, "true")
            .when(variant == 8, '"7"')
            .when(variant == 13, "99999999999")
            .otherwise(fixture_score(text).cast("string"))
        )
        return F.concat(F.lit('{"id":'), number, F.lit(',"score":'), score, F.lit("}"))

    items = F.transform("headlines", item)
    ordered = F.when(variant == 1, F.reverse(items)).when(
        variant == 2, F.slice(items, 1, F.size(items) - 1)
    ).when(variant == 12, F.concat(items, F.array(F.lit("null")))).otherwise(items)
    listed = F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))
    whole = F.concat(F.lit('{"results":'), listed, F.lit("}"))
    body = (
        F.when(variant == 9, F.substring(whole, F.lit(1), F.length(whole) - 2))
        .when(variant == 10, listed)
        .when(variant == 11, '{"results":{"id":1,"score":0}}')
        .otherwise(whole)
    )
    return (
        request_rows(spark, sf_dir)
        .withColumn("variant", (F.col("batch_no") % RESPONSE_VARIANTS).cast("int"))
        .withColumn("body", body)
    )


def envelope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in their envelopes: primary text or object, failed, or misshapen; fallback text."""
    kind = F.col("batch_no") % 5
    text = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.col("body").alias("response")).alias("result")))
    as_object = F.concat(F.lit('{"result":{"response":'), F.col("body"), F.lit('},"success":true}'))
    failed = F.to_json(F.struct(F.lit(False).alias("success"), F.struct(F.col("body").alias("response")).alias("result")))
    quoted = F.to_json(F.struct(F.lit("true").alias("success"), F.struct(F.col("body").alias("response")).alias("result")))
    primary = (
        F.when(kind == 1, as_object).when(kind == 2, failed).when(kind == 3, quoted).otherwise(text)
    )
    sound = F.concat(
        F.lit('{"results":['),
        F.array_join(
            F.transform(
                "headlines",
                lambda h, i: F.concat(
                    F.lit('{"score":'), fixture_score(h).cast("string"), F.lit(',"id":'), (i + 1).cast("string"), F.lit("}")
                ),
            ),
            ",",
        ),
        F.lit("]}"),
    )
    fallback = F.when(F.col("batch_no") % 7 == 0, '{"candidates":[]}').otherwise(
        F.to_json(
            F.struct(
                F.array(
                    F.struct(F.struct(F.array(F.struct(sound.alias("text"))).alias("parts")).alias("content"))
                ).alias("candidates")
            )
        )
    )
    return response_rows(spark, sf_dir).withColumns({"primary_response": primary, "fallback_response": fallback})
