import html
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tickertone.functions import text as tx


def plain_clean(value):
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", value or "")).split())


def cleaned(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").coalesce(1)
    return [r.t for r in rows.select("i", tx.clean_text(F.col("v")).alias("t")).orderBy("i").collect()]


def test_whitespace_is_what_python_strips(spark):
    points = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF]
    rows = spark.createDataFrame([(c, f"a{c}b") for c in points], "c string, v string")
    spaces = rows.where(tx.collapse(F.col("v")) == "a b").select("c").collect()
    assert {r.c for r in spaces} == {c for c in points if c.isspace()} == set(tx.WHITESPACE)


def test_clean_text_cases(spark):
    values = [
        None, "", "  ", "plain", "<p>a</p><p>b</p>", "&lt;b&gt;x&lt;/b&gt; &amp;amp; <i>y</i>",
        "&amp;lt; stays text", "caf&eacute; &#8217;quoted&#x2019; &hellip;", "a&nbsp;b c\x1cd", "R&D & more &copy 2024",
        "unclosed <b text", "&unknown; &#0;", "<a href='?a=1&b=2'>link</a> text", "नयाँ <b>योजना</b>",
    ]
    assert cleaned(spark, values) == [plain_clean(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.lists(
            st.sampled_from(
                ["&amp;", "&lt;", "&gt;", "&quot;", "&nbsp;", "&eacute;", "&#39;", "&#x41;", "&", ";", "amp;", "<b>", "</b>",
                 "<", ">", " ", "\n", " ", "lt;", "#", "x", "word", "é"]
            ),
            max_size=12,
        ).map("".join),
        min_size=60,
        max_size=60,
    )
)
def test_clean_text_agrees_with_python(spark, values):
    assert cleaned(spark, values) == [plain_clean(v) for v in values]


def test_excerpt_choice(spark):
    rows = spark.createDataFrame(
        [
            (1, ["<p> </p>", "<p>first</p>", "second"], "sum", "desc"),
            (2, ["&nbsp;"], "<i>sum</i>", "desc"),
            (3, None, "", "<i>desc</i>"),
            (4, [], None, None),
            (5, None, " ", "desc"),
            (6, ["x" * 6001], None, None),
            (7, [None, "é" * 7000], None, None),
        ],
        "i int, content array<string>, summary string, description string",
    )
    text = tx.excerpt(F.col("content"), F.col("summary"), F.col("description"), 6000)
    got = {r.i: r.t for r in rows.select("i", text.alias("t")).collect()}
    assert got == {1: "first", 2: "sum", 3: "desc", 4: "", 5: "", 6: "x" * 6000, 7: "é" * 6000}


def test_web_links(spark):
    rows = spark.createDataFrame([("http://a",), ("https://a",), ("ftp://a",), ("xhttp://a",), (None,)], "v string")
    assert [r[0] for r in rows.select(tx.is_web_link(F.col("v"))).collect()] == [True, True, False, False, False]
