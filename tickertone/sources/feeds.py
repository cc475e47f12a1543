"""Feed documents (RSS, RDF, Atom) to entries.

A document is one row; its entries are cut out and parsed one by one, so a document that is
broken somewhere still gives the entries that are whole. Feeds spread over tasks by document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickertone.functions.text import blank, is_web_link

# Element names of RSS, RDF and Atom entries.
_ENTRY = """
    title string,
    link array<struct<_VALUE: string, _href: string, _rel: string>>,
    guid struct<_VALUE: string, _isPermaLink: string>,
    `content:encoded` array<string>, content array<string>,
    summary string, description string,
    pubDate string, published string,
    updated string, `dc:date` string,
    _corrupt_record string
"""
_ENTRY_START = r"(?=<(?:item|entry)[\s>])"
_ENTRY_TAGS = r"(?s)^<(item|entry)(?:\s[^>]*)?>.*?</\1\s*>"
# Name spaces whose elements may carry a prefix.
_PREFIXED = r"""xmlns:([\w-]+)\s*=\s*["'](?:http://www\.w3\.org/2005/Atom|http://purl\.org/rss/1\.0/)["']"""
_BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9a-fA-F]+);)"


def read_feed_files(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Whole feed files as ``url, document``.

    Files lie under ``url=<percent-encoded address>/``, so the address is a partition column.
    """
    source = spark.readStream if stream else spark.read
    source = source.format("binaryFile").option("recursiveFileLookup", "false")
    if stream:
        source = source.schema("path string, modificationTime timestamp, length long, content binary, url string")
        if max_files:
            source = source.option("maxFilesPerTrigger", max_files)
    return decoded(source.load(path))


@F.pandas_udf(T.StringType())
def _decode(content: pd.Series, charset: pd.Series) -> pd.Series:
    def text(data: bytes | None, name: str) -> str | None:
        if data is None:
            return None
        try:
            return data.decode(name, "replace")
        except LookupError:
            return data.decode("utf-8", "replace")

    return pd.Series([text(d, n) for d, n in zip(content, charset, strict=True)], dtype=object)


def decoded(files: DataFrame) -> DataFrame:
    """``url, document, damaged`` of ``url, content``: text by the encoding that a file declares.

    That is its byte order mark, else its XML declaration, else UTF-8. Bytes that do not belong to
    the encoding become replacement characters and mark the document as damaged; nothing fails the
    job. UTF-8 stays in the JVM, files in other encodings are sent to Python.
    """
    content = F.col("content")
    wide = F.substring(F.hex(F.substring(content, 1, 2)), 1, 4).isin("FEFF", "FFFE")
    plain = F.decode(content, "ISO-8859-1")  # never fails, and keeps the declaration readable
    declaration = F.when(plain.rlike(r"^(?:\xEF\xBB\xBF)?\s*<\?xml"), F.substring_index(plain, "?>", 1))
    declared = F.upper(F.regexp_extract(F.coalesce(declaration, F.lit("")), r"""encoding\s*=\s*["']([A-Za-z0-9._:-]+)["']""", 1))
    charset = F.when(wide, "UTF-16").otherwise(F.when(declared.isin("", "UTF-8", "UTF8", "US-ASCII", "ASCII"), "UTF-8").otherwise(declared))
    named = files.select("url", "content", charset.alias("_charset"))
    utf8 = F.col("_charset") == "UTF-8"
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")
    other = _decode(F.when(~utf8, content), F.col("_charset"))
    document = F.when(utf8, text).otherwise(other)
    damaged = F.when(utf8, ~F.is_valid_utf8(content.cast("string"))).otherwise(F.coalesce(document.contains("\ufffd"), F.lit(False)))
    # A generator's result is computed once, though flag and text are both read from it.
    both = F.explode(F.array(F.struct(document.alias("document"), F.coalesce(damaged, F.lit(False)).alias("damaged")))).alias("_read")
    return named.select("url", both).select("url", "_read.document", "_read.damaged")


def plain_markup(document: Column) -> Column:
    """Markup without comments, character data as escaped text, and entries without a prefix.

    After this an entry ends at the first closing tag that follows its opening tag.
    """

    def escaped(text: Column) -> Column:
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(name))
        return text

    def part(text: Column, at: Column) -> Column:
        end = F.locate("]]>", text)
        data = F.concat(escaped(F.substring_index(text, "]]>", 1)), F.when(end > 0, F.substring(text, end + 3, F.length(text))).otherwise(""))
        return F.when(at == 0, text).otherwise(data)

    parts = F.array_join(F.transform(F.split(document, r"<!\[CDATA\["), part), "")
    text = F.when(document.contains("<![CDATA["), parts).otherwise(document)
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    prefix = F.regexp_extract(text, _PREFIXED, 1)
    bare = F.regexp_replace(text, F.concat(F.lit("<(/?)"), prefix, F.lit(":")), F.lit("<$1"))
    used = (prefix != "") & (text.contains(F.concat(F.lit("<"), prefix, F.lit(":entry"))) | text.contains(F.concat(F.lit("<"), prefix, F.lit(":item"))))
    return F.when(used, bare).otherwise(text)


def malformed(document: Column) -> Column:
    """True when the document is not well-formed XML or goes on after its root element."""
    broken = F.from_xml(document, "_corrupt_record string")["_corrupt_record"].isNotNull()
    bare = F.regexp_replace(document, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>", "")
    closing = F.concat(F.lit("</"), F.regexp_extract(bare, r"<([A-Za-z_][\w:.-]*)", 1))
    after = F.regexp_replace(F.call_function("substring_index", bare, closing, F.lit(-1)), r"^\s*>", "")
    trailing = bare.contains(closing) & ~blank(after)
    return document.isNull() | broken | trailing


def _parse(entry: Column) -> Column:
    return F.from_xml(entry, _ENTRY)


def _link(entry: Column) -> Column:
    """Link text, else the alternate link's address, else a guid that is a permanent link."""
    text = F.filter(entry["link"], lambda x: x["_VALUE"].isNotNull())
    address = F.filter(
        entry["link"], lambda x: x["_href"].isNotNull() & (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    )
    guid = F.when(F.coalesce(entry["guid"]["_isPermaLink"], F.lit("true")) != "false", entry["guid"]["_VALUE"])
    return F.coalesce(F.get(text, F.lit(0))["_VALUE"], F.get(address, F.lit(0))["_href"], guid)


def read_entries(documents: DataFrame, document: str = "document") -> DataFrame:
    """Entries of each document, with its other columns, its malformed flag and the entry's place.

    An entry that does not parse is tried again with stray ampersands escaped. One that is never
    closed ends where the next begins and is left out.
    """
    return _parsed(_cut(documents, document).where(F.col("_text") != ""))


def feed_health(documents: DataFrame, document: str = "document") -> DataFrame:
    """``url, malformed, found, kept``: entry openings of each feed and the entries that are used.

    A feed without entries has a row of zeros, so that a dead feed can be seen.
    """
    cut = _cut(documents, document)
    found = cut.groupBy("url").agg(F.max("malformed").alias("malformed"), F.count("_text").alias("found"))
    kept = keep_usable(_parsed(cut.where(F.col("_text") != ""))).groupBy("url").agg(F.count("*").alias("kept"))
    return found.join(kept, "url", "left").select("url", "malformed", "found", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def _cut(documents: DataFrame, document: str) -> DataFrame:
    """A row for each entry opening, its text empty if it is never closed; one with null for no opening at all."""
    keep = [c for c in documents.columns if c not in (document, "damaged")]
    flag = malformed(F.col(document))
    if "damaged" in documents.columns:
        flag = flag | F.col("damaged")
    pieces = F.slice(F.split(plain_markup(F.concat(F.lit(" "), F.col(document))), _ENTRY_START), 2, 1 << 30)
    texts = F.transform(pieces, lambda x: F.regexp_extract(x, _ENTRY_TAGS, 0))
    return documents.select(*keep, flag.alias("malformed"), texts.alias("_texts")).select(
        *keep, "malformed", F.posexplode_outer("_texts").alias("entry_no", "_text")
    )


def _parsed(cut: DataFrame) -> DataFrame:
    keep = [c for c in cut.columns if c not in ("malformed", "entry_no", "_text")]
    # A generator's result is a column like any other to the optimizer, so each parse runs once
    # instead of once per field and filter that reads it.
    strict = cut.select("*", F.explode(F.array(_parse(F.col("_text")))).alias("_strict"))
    repaired = _parse(F.regexp_replace("_text", _BARE_AMPERSAND, "&amp;"))
    sound = F.col("_strict._corrupt_record").isNull()
    entry = F.col("_entry")
    parsed = strict.select(
        *keep, "malformed", "entry_no",
        F.explode(F.array(F.when(sound, F.col("_strict")).otherwise(repaired))).alias("_entry"),
    )
    return parsed.where(entry["_corrupt_record"].isNull()).select(
        *keep,
        "malformed",
        "entry_no",
        entry["title"].alias("title"),
        _link(entry).alias("link"),
        F.coalesce(entry["content:encoded"], entry["content"]).alias("content"),
        entry["summary"].alias("summary"),
        entry["description"].alias("description"),
        F.coalesce(entry["pubDate"], entry["published"]).alias("published"),
        F.coalesce(entry["updated"], entry["dc:date"]).alias("updated"),
    )


def keep_usable(entries: DataFrame) -> DataFrame:
    """From malformed documents keep entries with a title and a web link; others pass whole."""
    usable = ~blank(F.col("title")) & is_web_link(F.col("link"))
    return entries.where(~F.col("malformed") | usable)
