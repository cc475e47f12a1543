"""Removal of word windows that the corpus holds more than once, by FM-indexes over shards.

Equal windows must meet in one shard. Each window has a minimiser, its run of SEED words with the
least hash; consecutive windows of one document with the same minimiser make a segment, and equal
windows have equal minimisers, so segments are dealt by minimiser. One whose minimiser stands alone
in the corpus has no repeated window and is left out before any text moves. Segments with the same
words are one, with a weight. Each shard gets an index over its segments; the segments are streamed
through it, and matching statistics of a window's length and of weight two or more mark the windows
that repeat. The segments of a minimiser with very many different ones are cut into windows: equal
windows are one, with a weight, before any text moves, those of weight two or more are dealt one by
one, and their marks are joined back to the segments by the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickertone.llm.fmindex import FMIndex
from tickertone.llm.shared import written
from tickertone.llm.text import _ODD_WORDS, _power_tables, mixed, pieces, run_hashes, text_bytes, word_hashes, word_spans

WINDOW, SEED = 35, 8
#: Words of one index, and different segments of one minimiser from which on its windows are folded and dealt one by one.
SHARD_WORDS, HOT_SEGMENTS = 1 << 20, 4096
#: Windows of one segment at most: its marks are the bits of a long.
_MARKS = 60
_PLACE_BITS = 26  # words of one batch piece


def segments(words: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and minimiser of each segment; first has the first word of each row and the end."""
    span = window - seed + 1
    grams = run_hashes(words, seed)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(grams) >> _PLACE_BITS:
        return _in_parts(words, first, window, seed)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least, width = (mixed(grams) & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while width * 2 <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    chosen = (least & low).astype(np.int64)  # of the window that starts here; the leftmost of equal ones
    inside = np.zeros(len(chosen) + 1, np.int64)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    full = counts > 0
    np.add.at(inside, first[:-1][full], 1)
    np.add.at(inside, (first[:-1] + counts)[full], -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    chosen = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    new[np.searchsorted(starts, first[:-1][full])] = True  # a new row begins a new segment
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(starts)))
    if span > _MARKS:
        parts = -(-sizes // _MARKS)
        index = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        heads = np.repeat(heads, parts) + index * _MARKS
        sizes = np.minimum(np.repeat(sizes, parts) - index * _MARKS, _MARKS)
    return starts[heads], sizes, grams[chosen[heads]]


def _in_parts(words: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As segments, for more words than a place can number: overlapping parts, each with all windows of its own."""
    step, found = (1 << _PLACE_BITS) - 2 * window, []
    for at in range(0, len(words), step):
        part = words[at : at + step + window - 1]
        cuts = np.unique(np.clip(first - at, 0, len(part)))
        starts, sizes, names = segments(part, np.unique(np.append(cuts, [0, len(part)])), window, seed)
        found.append((starts + at, sizes, names))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, k1, k2 (128 bits of id and text) and text of each row."""
    id_, content = F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(id_.alias("id"), F.xxhash64(id_, content).alias("k1"), F.xxhash64(F.lit(1), id_, content).alias("k2"), F.col(f"`{text}`").alias("text"))


def _row_spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    return data, *word_spans(data, offsets)


def _segments(keyed: DataFrame, window: int, seed: int, each: bool = False) -> DataFrame:
    """k1, k2, place (first word << 8 | windows), name (of the minimiser) and words (a hash) of each segment; with each, a hash of each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, starts, ends, first = _row_spans(batch)
                words = word_hashes(data, starts, ends)
                heads, sizes, names = segments(words, first, window, seed)
                power, inverse = _power_tables(_ODD_WORDS, len(words) + 1)
                total = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(words * power[: len(words)], out=total[1:])
                hashes = mixed((total[heads + sizes + window - 1] - total[heads]) * inverse[heads])
                row = np.searchsorted(first, heads, side="right") - 1
                place = (heads - first[row]) << 8 | sizes
                columns = [batch.column("k1").take(pa.array(row)), batch.column("k2").take(pa.array(row)), pa.array(place), pa.array(names.view(np.int64)), pa.array(hashes.view(np.int64))]
                if each:
                    cuts = np.append(0, np.cumsum(sizes))
                    at = np.repeat(heads - cuts[:-1], sizes) + np.arange(cuts[-1])
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(run_hashes(words, window)[at].view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "place", "name", "words", "each"][: len(columns)])

    return keyed.select("k1", "k2", "text").mapInArrow(run, f"k1 long, k2 long, place long, name long, words long{', each array<long>' if each else ''}")


def _hot_windows(keyed: DataFrame, hot: DataFrame, window: int, seed: int) -> DataFrame:
    """name, words, offset and one (its hash) of each window of each different segment of the hot minimisers, with the segment's weight and source."""
    found = _segments(keyed, window, seed, each=True).join(hot.select("name"), "name")
    distinct = found.groupBy("name", "words").agg(F.count("*").alias("weight"), F.min(F.struct("k1", "k2", "place", "each")).alias("source"))
    return written(distinct.select("name", "words", "weight", "source.k1", "source.k2", "source.place", F.posexplode("source.each").alias("offset", "one")))


def _texts(rows: DataFrame, window: int, shards: int) -> DataFrame:
    """shard, name, words, hot, windows, weight and the text of each segment or hot window.

    rows have text and wanted: structs of place, words, weight, name and hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                out: list[tuple] = []
                for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                    parts = text.encode().split()
                    for x in wanted:
                        at, count = x["place"] >> 8, x["place"] & 255
                        shard = (x["name"] + x["words"] * x["hot"]) % shards
                        out.append((shard, x["name"], x["words"], x["hot"], count, x["weight"], b" ".join(parts[at : at + count + window - 1])))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
                columns = zip(*out, strict=True) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "name", "words", "hot", "windows", "weight", "text"])

    return rows.select("text", "wanted").mapInArrow(run, "shard long, name long, words long, hot boolean, windows int, weight long, text binary")


def repeated_in(texts: list[bytes], windows: np.ndarray, weights: np.ndarray, window: int) -> np.ndarray:
    """Bits of the windows of each segment that weigh two or more in an index over all of them."""
    data, starts, ends, first = _row_spans(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.binary()).cast(pa.string())}))
    index = FMIndex(word_hashes(data, starts, ends), np.diff(first), weights, window)
    full = index.matching_statistics(2) >= window
    marks = np.zeros(len(texts), np.int64)
    for bit in range(int(windows.max())):
        rows = np.flatnonzero(windows > bit)
        marks[rows] |= full[index.starts[rows] + bit].astype(np.int64) << bit
    return marks


def _marked(dealt: DataFrame, window: int) -> DataFrame:
    """name, words, hot and marks of each segment or hot window with a repeat; the rows of a shard come together."""
    ordered = dealt.repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {}

        def found() -> Iterator[pa.RecordBatch]:
            keys, entries = list(held), list(held.values())
            marks = repeated_in([x[0] for x in entries], np.array([x[1] for x in entries]), np.array([x[2] for x in entries]), window)
            some = np.flatnonzero(marks)
            columns = [pa.array([keys[i][k] for i in some], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks[some])], names=["name", "words", "hot", "marks"])

        for batch in ordered_columns(batches):
            for now, name, words, hot, windows, weight, text in batch:
                if now != shard:
                    if held:
                        yield from found()
                    shard, held = now, {}
                held[name, words, hot] = (text, windows, weight)  # rows that stand twice in docs give a segment twice
        if held:
            yield from found()

    def ordered_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[zip]:
        for batch in batches:
            yield zip(*(batch.column(c).to_pylist() for c in ("shard", "name", "words", "hot", "windows", "weight", "text")), strict=True)

    return ordered.mapInArrow(run, "name long, words long, hot boolean, marks long")


def repeated_windows(
    docs: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    shard_words: int = SHARD_WORDS,
    hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """k1, k2 (see _keyed) and spots: structs of place and marks, the repeated windows of a document's segments."""
    keyed = _keyed(docs, id_column, text)
    seed = min(seed, window)
    found = _segments(keyed, window, seed)
    # Count first: only segments whose minimiser stands twice move on. Counts are written, since a hot key is
    # split only in a join whose sides come as they are, not aggregated in the same stage.
    shared = written(found.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), small=True)
    found = written(found.join(shared, "name"))
    distinct = found.groupBy("name", "words").agg(F.count("*").alias("weight"), F.min(F.struct("k1", "k2", "place")).alias("source"))
    distinct = written(distinct)
    hot = written(distinct.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > hot_segments), small=True)
    dealt = distinct.select("name", "words", "weight", "source.*", F.lit(False).alias("hot"))
    spread = hot.first() is not None
    if spread:
        cut = _hot_windows(keyed, hot, window, seed)
        one = F.struct("k1", "k2", F.shiftleft(F.shiftright("place", 8) + F.col("offset"), 8).bitwiseOR(F.lit(1)).alias("place"))
        # Count first: a window that stands alone has no repeat.
        repeated = cut.groupBy("name", F.col("one").alias("words")).agg(F.sum("weight").alias("weight"), F.min(one).alias("source")).where("weight > 1")
        repeated = written(repeated)
        dealt = dealt.join(hot.select("name"), "name", "left_anti").unionByName(repeated.select("name", "words", "weight", "source.*", F.lit(True).alias("hot")))
    size = dealt.agg(F.sum(F.col("place").bitwiseAND(255) + window - 1)).first()[0] or 0
    shards = max(1, -(-size // shard_words))
    by_text = dealt.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "words", "weight", "name", "hot")).alias("wanted"))
    sources = keyed.join(by_text.hint("shuffle_hash"), ["k1", "k2"])
    marks = written(_marked(_texts(sources, window, shards), window).groupBy("name", "words", "hot").agg(F.bit_or("marks").alias("marks")))
    if spread:
        back = cut.join(marks.where("hot").select("name", F.col("words").alias("one")), ["name", "one"])
        back = written(back.groupBy("name", "words").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("marks")), small=True)
        marks = marks.where(~F.col("hot")).select("name", "words", "marks").unionByName(back)
    return found.join(marks.select("name", "words", "marks"), ["name", "words"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "marks")).alias("spots"))


def without_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text: str = "text",
    digests: bool = False,
    seed: int = SEED,
    shard_words: int = SHARD_WORDS,
    hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """id, n_words, n_removed and kept (or kept_sha256) of each row of docs, and spans: the removed word ranges.

    Words are runs of characters other than ASCII white space. A window is window consecutive words
    of one text; all words of a window that starts anywhere else too, in the same text or another,
    are removed. Windows are judged on the input, so all copies go. A null text has no words; a text
    shorter than the window loses nothing; repeated rows count as texts of their own. Kept words are
    joined by one space.
    """
    spots = repeated_windows(docs, window, id_column, text, seed, shard_words, hot_segments)
    keyed = _keyed(docs, id_column, text)
    joined = keyed.join(spots.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                n_words, n_removed, kept, spans = [], [], [], []
                for content, spots_ in zip(batch.column("text").to_pylist(), batch.column("spots").to_pylist(), strict=True):
                    parts = (content or "").encode().split()
                    depth = np.zeros(len(parts) + 1, np.int64)
                    for spot in spots_ or []:
                        at = spot["place"] >> 8
                        for bit in range(spot["place"] & 255):
                            if spot["marks"] >> bit & 1:
                                depth[at + bit] += 1
                                depth[at + bit + window] -= 1
                    gone = np.cumsum(depth)[:-1] > 0
                    left = b" ".join(compress(parts, (~gone).tolist()) if spots_ else parts)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    n_words.append(len(parts))
                    n_removed.append(int(gone.sum()))
                    kept.append(hashlib.sha256(left).hexdigest() if digests else left.decode())
                    spans.append(edges.reshape(-1, 2).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                    names=["id", "n_words", "n_removed", "kept_sha256" if digests else "kept", "spans"],
                )

    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, {'kept_sha256' if digests else 'kept'} string, spans array<array<long>>")
