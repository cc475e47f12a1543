from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import functions as F

from tickertone.plans.articles import build_articles, tag_entries
from tickertone.sources.feeds import decoded, feed_health, keep_usable, malformed, read_entries, read_feed_files
from tickertone.sources.registry import FEEDS, count_by_region, default_registry, read_registry
from tickertone.sources.topic import decode_messages, encode_messages

RSS = (
    "<?xml version='1.0'?><!-- feed --><rss version='2.0' xmlns:content='http://purl.org/rss/1.0/modules/content/'><channel>"
    "<title>Channel</title>"
    "<item><title>Rates &amp; prices</title><link>https://a.test/1</link><description>Short</description>"
    "<content:encoded><![CDATA[<p>Long &eacute; text</p>]]></content:encoded><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>"
    "<item><title/><link>https://a.test/2</link></item>"
    "<item><link>https://a.test/3</link></item>"
    "<item><title>Guid only</title><guid>https://a.test/4</guid></item>"
    "<item><title>No link</title><guid isPermaLink='false'>x</guid></item>"
    "</channel></rss>"
)
ATOM = (
    "<feed xmlns='http://www.w3.org/2005/Atom'><title>T</title><entry><title type='html'>Atom story</title>"
    "<link rel='self' href='https://b.test/self'/><link rel='alternate' href='https://b.test/1'/>"
    "<summary>Sum</summary><updated>2024-01-02T03:04:05Z</updated></entry></feed>"
)
RDF = (
    "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/'>"
    "<item rdf:about='https://c.test/1'><title>RDF story</title><link>https://c.test/1</link></item></rdf:RDF>"
)
TRAILING = (
    "<feed xmlns='http://www.w3.org/2005/Atom'><entry><link href='https://d.test/harbour/7'/><title>Harbour reopens</title></entry>"
    "<entry><title>Sent by mail</title><link href='mailto:desk@d.test'/></entry></feed><note>page 2 of 2</note> 42 <"
)
BROKEN = "<rss version='2.0'><channel><title>Open</title><item><title>Never"
HALF = (
    "<rss><channel><item><title>one</title><link>https://e.test/1</link></item>"
    "<item><title>two & three</title><link>https://e.test/2</link></item></channel></rss>"
)


def documents(spark, **docs):
    return spark.createDataFrame(list(docs.items()), "url string, document string")


def test_malformed_flag(spark):
    rows = documents(
        spark, rss=RSS, atom=ATOM, rdf=RDF, trailing=TRAILING, broken=BROKEN, half=HALF, text="no markup", empty="",
        commented=RSS + "<!-- made </rss> by hand -->\n", none=None,
    )
    got = {r.url: r.m for r in rows.select("url", malformed(F.col("document")).alias("m")).collect()}
    assert got == {
        "rss": False, "atom": False, "rdf": False, "trailing": True, "broken": True, "half": True, "text": True,
        "empty": True, "commented": False, "none": True,
    }


def test_entries_of_every_format(spark):
    rows = read_entries(documents(spark, rss=RSS, atom=ATOM, rdf=RDF)).collect()
    got = {(r.url, r.entry_no): (r.title, r.link) for r in rows}
    assert got == {
        ("rss", 0): ("Rates & prices", "https://a.test/1"),
        ("rss", 1): ("", "https://a.test/2"),
        ("rss", 2): (None, "https://a.test/3"),
        ("rss", 3): ("Guid only", "https://a.test/4"),
        ("rss", 4): ("No link", None),
        ("atom", 0): ("Atom story", "https://b.test/1"),
        ("rdf", 0): ("RDF story", "https://c.test/1"),
    }


def test_recovery_before_trailing_markup(spark):
    rows = keep_usable(read_entries(documents(spark, d=TRAILING))).collect()
    assert [(r.malformed, r.title) for r in rows] == [(True, "Harbour reopens")]


def test_nothing_from_a_document_without_entries(spark):
    assert keep_usable(read_entries(documents(spark, d=BROKEN))).count() == 0


def test_stray_ampersand_is_repaired(spark):
    rows = keep_usable(read_entries(documents(spark, d=HALF))).orderBy("entry_no").collect()
    assert [r.title for r in rows] == ["one", "two & three"]


def test_well_formed_documents_are_not_filtered(spark):
    assert keep_usable(read_entries(documents(spark, rss=RSS))).count() == 5


def test_files_to_messages(spark, tmp_path):
    url = FEEDS[0][0]
    folder = tmp_path / f"url={quote(url, safe='')}"
    folder.mkdir()
    (folder / "a.xml").write_bytes(RSS.encode())
    latin = "<?xml version='1.0' encoding='ISO-8859-1'?><rss><channel><item><title>Café</title></item></channel></rss>"
    (folder / "b.xml").write_bytes(latin.encode("latin-1"))
    at = datetime(2024, 1, 3, tzinfo=timezone.utc)
    entries = keep_usable(read_entries(read_feed_files(spark, str(tmp_path))))
    articles = build_articles(tag_entries(entries, default_registry(spark)), at)
    got = {r.title: r for r in decode_messages(encode_messages(articles)).collect()}
    assert set(got) == {"Rates & prices", "", "Guid only", "No link", "Café"}
    first = got["Rates & prices"]
    assert (first.text, first.source, first.region) == ("Long é text", "BBC", "International")
    assert first.published_at == datetime(2024, 1, 2, 3, 4, 5) and first.ingested_at == datetime(2024, 1, 3)
    assert got["No link"].link == "No Link Provided" and got["Café"].published_at is None


def test_missing_title_dropped_empty_title_kept(spark):
    rows = spark.createDataFrame(
        [("u", None), ("u", "No Title Provided"), ("u", ""), ("u", "  x ")], "url string, title string"
    )
    for name, kind in (("content", "array<string>"), ("summary", "string"), ("description", "string"), ("link", "string"),
                       ("published", "string"), ("updated", "string"), ("source", "string"), ("region", "string")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    assert sorted(r.title for r in build_articles(rows).collect()) == ["", "x"]


def test_registry(spark, tmp_path):
    registry = default_registry(spark)
    assert {(r.region, r.feeds) for r in count_by_region(registry).collect()} == {("International", 12), ("Nepali", 7)}
    registry.write.option("header", "true").csv(str(tmp_path / "r"))
    assert read_registry(spark, str(tmp_path / "r")).count() == 19


def test_messages(spark):
    raw = spark.createDataFrame(
        [
            (1, '{"title":"a","published_at":"2024-01-02T03:04:05Z","ingested_at":"soon"}'),
            (2, "not json"),
            (3, '{"title":7,"link":"l","source":"s"}'),
            (4, None),
        ],
        "seq bigint, value string",
    )
    got = {r.seq: (r.title, r.published_at, r.ingested_at, r.source) for r in decode_messages(raw).collect()}
    assert got == {
        1: ("a", datetime(2024, 1, 2, 3, 4, 5), None, None), 2: (None,) * 4, 3: ("7", None, None, "s"), 4: (None,) * 4,
    }


def test_null_fields_are_written(spark):
    rows = spark.createDataFrame(
        [(None, None, None, None, None, None, None)],
        "title string, text string, link string, source string, region string, published_at timestamp, ingested_at timestamp",
    )
    assert encode_messages(rows).first().value.count("null") == 7


def files(spark, **contents):
    return decoded(spark.createDataFrame(list(contents.items()), "url string, content binary"))


def one(title, encoding=None, root="rss"):
    head = f"<?xml version='1.0' encoding='{encoding}'?>" if encoding else ""
    return f"{head}<{root} version='2.0'><channel><item><title>{title}</title><link>https://f.test/1</link></item></channel></{root}>"


def test_encodings_and_bad_bytes(spark):
    padded = "<?xml version='1.0'" + " " * 400 + "encoding='windows-1251'?>" + one("Мир")
    rows = files(
        spark, bad=one("caf\u00e9", "UTF-8").encode("latin-1"), wide=one("Ünïcode", "UTF-16").encode("utf-16"),
        quotes=one("It\u2019s", "windows-1252").encode("cp1252"), late=padded.encode("cp1251"), unknown=one("plain", "x-none").encode(),
        marked=b"\xef\xbb\xbf" + one("é", "utf-8").encode(), none=None, empty=b"",
    )
    got = {r.url: (r.title, r.malformed) for r in read_entries(rows).collect()}
    assert got == {
        "bad": ("caf\ufffd", True), "wide": ("Ünïcode", False), "quotes": ("It\u2019s", False), "late": ("Мир", False),
        "unknown": ("plain", False), "marked": ("é", False),
    }


def test_character_data_comments_and_open_entries(spark):
    link = "<link>https://g.test/1</link>"
    cdata = f"<rss><channel><item><title><![CDATA[see </item> & <b>tag</b>]]></title>{link}</item></channel></rss>"
    comment = f"<rss><channel><!-- <item><title>no</title></item> --><item><title>yes</title>{link}</item></channel></rss>"
    unclosed = f"<rss><channel><item><title>lost</title><item><title>sound</title>{link}</item></channel></rss>"
    prefixed = "<a:feed xmlns:a='http://www.w3.org/2005/Atom'><a:entry><a:title>P</a:title><a:link href='https://g.test/p'/></a:entry></a:feed>"
    extra = "<rss xmlns:atom='http://www.w3.org/2005/Atom'><channel><atom:link href='x'/>" + one("kept").split("<channel>")[1]
    long = f"<rss><channel><item><title>{'long ' * 200_000}</title>{link}</item></channel></rss>"
    rows = read_entries(documents(spark, cdata=cdata, comment=comment, unclosed=unclosed, prefixed=prefixed, extra=extra, long=long)).collect()
    got = {r.url: (r.title, r.link) for r in rows}
    assert len(rows) == 6 and len(got.pop("long")[0]) >= 999_999
    assert got == {
        "cdata": ("see </item> & <b>tag</b>", "https://g.test/1"), "comment": ("yes", "https://g.test/1"), "unclosed": ("sound", "https://g.test/1"),
        "prefixed": ("P", "https://g.test/p"), "extra": ("kept", "https://f.test/1"),
    }


def test_health_shows_dead_feeds(spark):
    rows = feed_health(documents(spark, rss=RSS, trailing=TRAILING, empty="", none=None)).collect()
    assert {r.url: (r.malformed, r.found, r.kept) for r in rows} == {"rss": (False, 5, 5), "trailing": (True, 2, 1), "empty": (True, 0, 0), "none": (True, 0, 0)}
