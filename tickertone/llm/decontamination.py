"""Benchmark decontamination over a distributed positional inverted index of the training tokens.

The index holds a posting (document, position, term) for each training word that some test item
uses. A test phrase is found from its rarest term: its postings, moved back by the term's offset, are
the possible starts; the list of the next rarest term, moved by its own offset, is intersected with
them; what remains is checked against the postings of all other terms of the phrase. Proximity
matches start from the rarest term's documents in the same way. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickertone.llm.shared import written

#: Fixed values of the contract: what is no part of a word (after lower-casing A-Z), words of a phrase.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_WORDS = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Term of the posting that every document has at position 0; words begin at 1.
START = 0


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    plain = F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BREAKS, " "), F.lit(" "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def phrase_table(items: DataFrame, size: int = PHRASE_WORDS, id_column: str = "item_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Different phrases (phrase, words) and which items hold them (phrase, item), both written.

    A phrase is a run of size consecutive words of an item, or all words of an item with fewer; it is
    a number from here on.
    """
    listed = items.select(F.col(f"`{id_column}`").alias("item"), words_of(F.col(f"`{text_column}`")).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    runs = listed.where(F.size("all") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("words"))
    phrases = written(runs.select("words").distinct().select(F.monotonically_increasing_id().alias("phrase"), "words"), small=True)
    held = written(runs.join(phrases, "words").where("item IS NOT NULL").select("phrase", "item").distinct(), small=True)
    return phrases, held


def term_table(phrases: DataFrame) -> DataFrame:
    """word, term: a number from 1 for each word of the phrases, and START for the mark of a document.

    The vocabulary of the test items is numbered in order of the words.
    """
    words = phrases.select(F.explode("words").alias("word")).distinct()
    # Numbers need not be dense: task and row of the sorted words.
    numbered = words.sort("word").select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    start = words.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(START).cast("long").alias("term"))
    return written(numbered.unionByName(start), small=True)


def positional_index(docs: DataFrame, terms: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Postings doc, doc_id, n_words, position, term of each row of docs, written in the order of the documents.

    doc numbers the rows, so rows of one id stay apart. Each has a posting (0, START), also without words.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("doc"),
        F.col(f"`{id_column}`").alias("doc_id"),
        words_of(F.col(f"`{text_column}`")).alias("words"),
    )
    tokens = rows.select("doc", "doc_id", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("position", "word"))
    return written(tokens.join(terms, "word").select("doc", "doc_id", "n_words", "position", "term"))


def rarest_first(phrases: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """phrase, size, places: the (frequency, offset, term) of each phrase's words, rarest first.

    Phrases with a word that no document has are left out.
    """
    frequency = written(index.groupBy("term").agg(F.count("*").alias("frequency")), small=True)
    placed = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    known = placed.join(terms, "word").join(frequency, "term")
    places = known.groupBy("phrase", "size").agg(F.sort_array(F.collect_list(F.struct("frequency", "offset", "term"))).alias("places"))
    return written(places.where(F.size("places") == F.col("size")), small=True)


def phrase_matches(index: DataFrame, places: DataFrame) -> DataFrame:
    """doc, begin, size, phrase: all exact occurrences; begin is the position of the first word."""

    def place(k: int) -> list[Column]:
        return [F.get("places", F.lit(k))[c].alias(c) for c in ("offset", "term")]

    postings = index.select("doc", "position", "term")
    # First lists: possible starts from the rarest term.
    first = written(places.select("phrase", "size", *place(0)), small=True)
    starts = postings.join(first, "term").select("doc", (F.col("position") - F.col("offset")).alias("begin"), "size", "phrase").where("begin >= 1")
    # Second lists: the postings of the next rarest terms alone, at their offsets.
    second = written(places.where("size > 1").select("phrase", *place(1)), small=True)
    second_terms = written(second.select("term").distinct(), small=True)
    second_postings = postings.join(second_terms, "term", "left_semi")
    expected = starts.join(second, "phrase").withColumn("position", F.col("begin") + F.col("offset"))
    both = expected.join(second_postings, ["doc", "position", "term"], "left_semi").select("doc", "begin", "size", "phrase")
    both = written(both)
    # All others: each has to be where the phrase wants it. Only documents that still count are read on.
    rest = written(places.where("size > 2").select("phrase", F.explode(F.slice("places", 3, 1 << 30)).alias("p")).select("phrase", "p.offset", "p.term"), small=True)
    wanted = both.join(rest, "phrase").select("doc", "begin", "size", "phrase", (F.col("begin") + F.col("offset")).alias("position"), "term")
    open_docs = written(both.where("size > 2").select("doc").distinct(), small=True)
    there = wanted.join(postings.join(open_docs, "doc", "left_semi"), ["doc", "position", "term"], "left_semi")
    full = there.groupBy("doc", "begin", "size", "phrase").agg(F.count("*").alias("n")).where("n = size - 2").drop("n")
    return starts.where("size = 1").unionByName(both.where("size = 2")).unionByName(full)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    size: int = PHRASE_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs.

    n_hit counts the words inside occurrences of phrases, n_items the different item ids with one.
    Null and empty texts have no words and no hits. Each row of docs gives one row, rows of one id or
    text too. Items of one id count as one; an item with a null id marks words but is not counted.
    Items without words have no phrase. An empty table of items leaves all documents clean, an empty
    table of documents gives no rows. Other columns are ignored.
    """
    phrases, held = phrase_table(items, size, item_column, item_text)
    terms = term_table(phrases)
    index = positional_index(docs, terms, id_column, text_column)
    matches = written(phrase_matches(index, rarest_first(phrases, terms, index)))
    # Words covered: each occurrence adds what reaches beyond those that begin before it.
    ends = matches.groupBy("doc", "begin").agg((F.col("begin") + F.max("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy("doc").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.col("end") - F.greatest("begin", F.coalesce(before, F.lit(0))), F.lit(0))
    hits = ends.withColumn("added", added).groupBy("doc").agg(F.sum("added").cast("long").alias("n_hit"))
    found = matches.select("doc", "phrase").distinct().join(held, "phrase").select("doc", F.col("item").cast("string").alias("item")).distinct()
    items_of = found.groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = written(hits.join(items_of, "doc", "left").select("doc", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    marks = marks.select("doc", "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("list"))
    rows = index.where(F.col("term") == START).select("doc", "doc_id", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.join(marks, "doc", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def proximity_matches(
    docs: DataFrame,
    items: DataFrame,
    within: int,
    size: int = PHRASE_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item, phrase, begin: spans of within words that hold all different words of a phrase, in any order.

    begin is the position (from 1) of a span's first word, which is one of the phrase's. Spans are
    sought in documents that hold the phrase's rarest term; a document's postings of one phrase are
    sorted and looked through once. Rows of one document and text are told apart only by their results.
    """
    phrases, held = phrase_table(items, size, item_column, item_text)
    terms = term_table(phrases)
    index = positional_index(docs, terms, id_column, text_column)
    places = rarest_first(phrases, terms, index)
    postings = index.select("doc", "position", "term")
    rarest = places.select("phrase", F.get("places", F.lit(0))["term"].alias("term"))
    pairs = written(postings.join(rarest, "term").select("doc", "phrase").distinct())
    needed = places.select("phrase", F.array_distinct("places.term").alias("terms")).select("phrase", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    near = pairs.join(needed, "phrase").join(postings, ["doc", "term"])
    span = Window.partitionBy("doc", "phrase").orderBy("position").rangeBetween(0, within - 1)
    spans = near.withColumn("seen", F.size(F.collect_set("term").over(span))).where(F.col("seen") == F.col("n"))
    ids = index.where(F.col("term") == START).select("doc", "doc_id")
    return spans.join(held, "phrase").join(ids, "doc").select("doc_id", "item", "phrase", F.col("position").alias("begin"))
