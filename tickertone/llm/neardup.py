"""N-gram Jaccard join by MinHash banding, and the groups that its links make.

Texts with the same set of n-grams are one class. Signatures are cut into bands; classes that share a
band hash meet in a bucket. Buckets that overlap get one label, so that a class travels once for
many buckets; a large label is cut into blocks, and pairs of blocks go to tasks of their own. There
every pair is verified on its full n-gram sets. Links are as many as the square of a group, so they
do not leave the task: a class leaves with the number of its links and the first class that they
lead to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickertone.llm.components import components
from tickertone.llm.shared import sets_aside, written
from tickertone.llm.text import mixed, pieces, text_bytes, text_key, word_hashes, word_spans
from tickertone.llm.text import _ODD_WORDS, _power_tables

GRAM, THRESHOLD, RECALL, MAX_HASHES = 5, Fraction(4, 5), 0.9995, 128
#: Classes and n-grams in one block of a label.
BLOCK_CLASSES, BLOCK_GRAMS = 1024, 1 << 20
_COLUMNS = 4096


def band_shape(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows a band: the most rows, so the fewest false candidates, that reach recall at the threshold within max_hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if not best:
        raise ValueError("no banding reaches this recall within max_hashes")
    return best


def gram_sets(column: pa.Array, size: int = GRAM) -> list[np.ndarray]:
    """Sorted hashes of the distinct word n-grams of each row; a row of fewer words has one of all its words, one without words none."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    power, inverse = _power_tables(_ODD_WORDS, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    grams = mixed((total[size:] - total[: max(len(words) - size + 1, 0)]) * inverse[: max(len(words) - size + 1, 0)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(grams[a : b - size + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif b > a:
            out.append(mixed((total[b : b + 1] - total[a : a + 1]) * inverse[a : a + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each set, and its band hashes; sets must not be empty."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    names = np.stack([np.add.reduceat(mixed(flat ^ mixed(np.uint64([salt]))), begins) for salt in (1, 2)], axis=1)
    factors = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    out = np.zeros((len(sets), bands), np.uint64)
    for i in range(bands * rows):
        least = np.minimum.reduceat(flat * (factors[2 * i] | np.uint64(1)) + factors[2 * i + 1], begins)
        band = i // rows
        out[:, band] = mixed(out[:, band] + least + np.uint64(band + 1))
    return names, out


def _signed(docs: DataFrame, id_column: str, text: str, bands: int, rows: int) -> DataFrame:
    """id, t1, t2, grams, name (null if a text has no words) and bands of each row."""
    keyed = docs.select(F.col(f"`{id_column}`").alias("id"), *text_key(F.col(f"`{text}`")), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                sets = gram_sets(batch.column("text"))
                full = [i for i, s in enumerate(sets) if len(s)]
                names, hashes = [None] * len(sets), [None] * len(sets)
                if full:
                    found, bands_ = signatures([sets[i] for i in full], bands, rows)
                    for i, name, row in zip(full, found, bands_.view(np.int64), strict=True):
                        names[i], hashes[i] = name.tobytes(), row
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("t1"), batch.column("t2"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                    names=["id", "t1", "t2", "grams", "name", "bands"],
                )

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"id {kind}, t1 long, t2 long, grams long, name binary, bands array<long>")


def links_within(sets: list[np.ndarray], side: np.ndarray | None, threshold: Fraction) -> np.ndarray:
    """Matrix of pairs of sets with a Jaccard similarity of threshold or more; with sides, only pairs of different sides."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n <= 8:
        common = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i + 1, n):
                if min(sizes[i], sizes[j]) * threshold.denominator >= threshold.numerator * max(sizes[i], sizes[j]):
                    common[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        common = np.zeros((n, n), np.float64)
        values, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)
        shared = counts[places] > 1
        rank = np.cumsum(counts > 1) - 1
        places, owner = rank[places[shared]], owner[shared]
        order = np.argsort(places, kind="stable")
        places, owner = places[order], owner[order]
        for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, _COLUMNS):
            a, b = np.searchsorted(places, [low, low + _COLUMNS])
            block = np.zeros((n, _COLUMNS), np.float32)  # counts stay below 2 ** 24
            block[owner[a:b], places[a:b] - low] = 1
            common += block @ block.T
        common = common.astype(np.int64)
    either = sizes[:, None] + sizes[None, :] - common
    linked = common * threshold.denominator >= threshold.numerator * either
    linked = np.triu(linked, 1)
    linked |= linked.T
    if side is not None:
        linked &= side[:, None] != side[None, :]
    return linked


def met_before(label: int, labels: list[list[int]]) -> np.ndarray:
    """Matrix of pairs that meet under a smaller label too, where their link is counted."""
    smaller = [sorted({x for x in own if x < label}) for own in labels]
    numbers = {x: i for i, x in enumerate(sorted({x for own in smaller for x in own}))}
    marks = np.zeros((len(labels), max(len(numbers), 1)), np.float32)
    for row, own in enumerate(smaller):
        marks[row, [numbers[x] for x in own]] = 1
    return marks @ marks.T > 0


def first_reached(linked: np.ndarray) -> np.ndarray:
    """The least number that each one is linked with, over any chain."""
    least = np.arange(len(linked))
    while True:
        now = np.minimum(least, np.where(linked, least[None, :], len(linked)).min(axis=1))
        now = now[now]
        if (now == least).all():
            return least
        least = now


def _verified(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """name, least, linked and linked_copies of each class with links under (label, low, high); rows come together and in order."""
    keys = ["label", "low", "high"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            once = sorted({m[0]: i for i, m in enumerate(members)}.items())  # repeated rows
            if len(once) < 2:
                return
            own = [members[i] for _, i in once]
            side = np.array([m[1] for m in own]) if key[1] != key[2] else None
            linked = links_within([sets[i] for _, i in once], side, threshold)
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                return
            counted = linked & ~met_before(key[0], [m[3] for m in own])
            copies = np.array([m[2] for m in own], np.int64)
            least = first_reached(linked)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([own[i][0] for i in some], pa.binary()),
                    pa.array([own[i][0] for i in least[some]], pa.binary()),
                    pa.array(counted.sum(axis=1)[some], pa.int64()),
                    pa.array((counted @ copies)[some], pa.int64()),
                ],
                names=["name", "least", "linked", "linked_copies"],
            )

        for whole in batches:
            for batch in pieces(whole, "text"):
                found = gram_sets(batch.column("text"))
                columns = [batch.column(c).to_pylist() for c in (*keys, "name", "block", "copies", "labels")]
                for *row, grams in zip(*columns, found, strict=True):
                    if row[:3] != key:
                        if key:
                            yield from links()
                        key, members, sets = row[:3], [], []
                    members.append(row[3:])
                    sets.append(grams)
        if key:
            yield from links()

    return dealt.mapInArrow(run, "name binary, least binary, linked long, linked_copies long")


def _first(id_: Column, t1: Column, t2: Column) -> Column:
    """Orders rows by id, null last, then by text."""
    return F.struct(id_.isNull().alias("none"), id_.alias("id"), t1.alias("t1"), t2.alias("t2"))


def _grouped(docs: DataFrame, id_column: str, text: str, threshold: Fraction, recall: float, block_classes: int, block_grams: int) -> tuple[DataFrame, DataFrame]:
    """Rows with id, t1, t2, name; and classes with name, copies, first row, root, group's first row, links."""
    bands, rows = band_shape(float(threshold), recall)
    signed = written(_signed(docs, id_column, text, bands, rows))
    full = signed.where(F.col("name").isNotNull())
    first = _first(F.col("id"), F.col("t1"), F.col("t2"))
    classes = written(full.groupBy("name").agg(F.count("*").alias("copies"), F.min(first).alias("first"), F.max("grams").alias("grams")))

    met = full.select("name", F.explode("bands").alias("band")).distinct()
    # A hot band is split only in a join whose sides come as they are, not aggregated in the same stage.
    buckets = written(met.groupBy("band").agg(F.count("*").alias("n"), F.min(F.xxhash64("name")).alias("label")).where("n > 1").drop("n"), small=True)
    met = written(met.join(buckets, "band"))
    # Buckets that share a class take the least of their labels, so most pairs meet under one label only.
    near = met.groupBy("name").agg(F.min("label").alias("near"))
    relabelled = written(met.select("name", "band").join(near, "name").groupBy("band").agg(F.min("near").alias("label")), small=True)
    own = met.select("name", "band").join(relabelled, "band").groupBy("name").agg(F.collect_set("label").alias("labels"))  # one for each band at most
    labels = written(own.join(classes, "name").withColumn("label", F.explode("labels")))
    sizes = labels.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block_classes), F.ceil(F.sum("grams") / block_grams)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("name", F.lit(7)), F.col("blocks")).cast("int")
    placed = labels.join(sizes, "label").withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("name", "first", "copies", "labels", "label", "block", other)
    placed = placed.select("name", F.col("first.*"), "copies", "labels", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    texts = docs.select(F.col(f"`{id_column}`").alias("id_"), *[k.alias(n) for k, n in zip(text_key(F.col(f"`{text}`")), ("t1_", "t2_"), strict=True)], F.col(f"`{text}`").alias("text"))
    same = F.col("id_").eqNullSafe(F.col("id")) & (F.col("t1_") == F.col("t1")) & (F.col("t2_") == F.col("t2"))
    met_texts = texts.join(placed.hint("shuffle_hash"), same).select("label", "low", "high", "block", "name", "copies", "labels", "text")
    links = written(_verified(met_texts, threshold))

    degrees = links.groupBy("name").agg(F.sum("linked").alias("linked"), F.sum("linked_copies").alias("linked_copies"))
    roots = components(links.select(F.col("name").alias("u"), F.col("least").alias("v"))).withColumnRenamed("node", "name")
    info = classes.drop("grams").join(degrees, "name", "left").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    info = written(info)
    heads = info.groupBy("root").agg(F.min("first").alias("head"))
    return signed, info.join(heads, "root")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    threshold: Fraction = THRESHOLD,
    recall: float = RECALL,
    block_classes: int = BLOCK_CLASSES,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """id, class_id, copies, n_linked_texts, n_links for each row of docs, repeated rows too.

    Two texts are linked if the Jaccard similarity of their sets of five-word runs is threshold or
    more (a text of one to four words has its whole word sequence as its only run). class_id is the
    smallest id that chains of links lead to. copies counts rows with the same set, the row itself
    included; n_linked_texts counts other sets that the row's set is linked with; n_links counts all
    other rows that the row is linked with. Texts without words, null ones too, are alone: class_id
    is their own id and the other counts are 1, 0 and 0. A pair of texts at the threshold is found
    with probability recall at least, a closer one more likely; no group is capped.
    """
    signed, classes = _grouped(docs, id_column, text, threshold, recall, block_classes, block_grams)
    found = classes.select(
        "name",
        F.col("head.id").alias("class_id"),
        "copies",
        F.coalesce("linked", F.lit(0)).alias("n_linked_texts"),
        (F.coalesce("linked_copies", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    joined = signed.select("id", "name").join(found, "name", "left")
    alone = F.col("name").isNull()
    return joined.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("n_linked_texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


@sets_aside(r"__.*|id|t1|t2|name|first|head")
def first_of_each_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The row with the smallest id of each group of near duplicates, with its own columns; texts without words all stay.

    Repeated rows of that id and text leave one.
    """
    signed, classes = _grouped(docs, id_column, text, threshold, recall, BLOCK_CLASSES, BLOCK_GRAMS)
    heads = classes.where(F.col("first") == F.col("head")).select(F.col("head.id").alias("__id"), F.col("head.t1").alias("__t1"), F.col("head.t2").alias("__t2"))
    rows = signed.where(F.col("name").isNotNull()).groupBy(F.col("id").alias("__i"), F.col("t1").alias("__a"), F.col("t2").alias("__b")).agg(F.count("*").alias("__rows"))
    heads = written(heads.join(rows, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__t1") == F.col("__a")) & (F.col("__t2") == F.col("__b"))).drop("__i", "__a", "__b"))
    t1, t2 = text_key(F.col(f"`{text}`"))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col("__id")) & (t1 == F.col("__t1")) & (t2 == F.col("__t2"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.join(heads.hint("shuffle_hash"), same)
    wordless = docs.where(~F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    once = joined.where("__rows = 1").select(*columns).unionByName(joined.where("__rows > 1").dropDuplicates(["__id", "__t1", "__t2"]).select(*columns))
    return once.unionByName(wordless)
