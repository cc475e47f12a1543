"""Grouping of spelling variants over a bit-sliced position index.

The index of a block of words holds, for each position and letter, the bitset of the words with that
letter there. Queries run through their letters; sets of words reached without an error and with one
(replaced, inserted or left out letter) move along together, by and, or and the bitsets of the
neighbouring positions, 64 words at a time.

Blocks are made so that near words meet: of the pieces of a word all but one are free of a single
error, so words are dealt by all but one of their pieces and by the length of the shorter word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickertone.llm.shared import written

#: Fixed values of the contract: letters, shortest word, least count, and the share of deleted letters.
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT, FORM_RATIO, NOISE = 7, 2, 10, 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Pieces of a word; words with all but one in common are compared.
PIECES = 3
#: Words and letters of one index. A larger group is cut into parts, and pairs of parts are compared.
BLOCK_WORDS, BLOCK_LETTERS = 1024, 1 << 16


class PositionIndex:
    """Bitsets by position and letter over a block of words, given as one array of letters and their lengths."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        self.n, self.lengths = len(lengths), lengths
        self.width = -(-self.n // 64) or 1
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        known, self.letters = np.unique(letters, return_inverse=True)
        word = np.repeat(np.arange(self.n), lengths)
        place = np.arange(len(letters)) - self.starts[word]
        pair, row = np.unique(place * max(len(known), 1) + self.letters, return_inverse=True)
        # rows[p, a]: which bitset position p and letter a have, 0 for the empty one.
        self.rows = np.zeros((int(lengths.max(initial=0)) + 2, max(len(known), 1)), np.int64)
        self.rows.reshape(-1)[pair] = np.arange(1, len(pair) + 1)
        self.bits = np.zeros((len(pair) + 1, self.width), np.uint64)
        np.bitwise_or.at(self.bits, (row + 1, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))

    def _packed(self, chosen: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.width * 64, np.uint8)
        padded[: self.n] = chosen
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) of block words one error apart; the queries are word numbers of one length."""
        size = int(self.lengths[queries[0]])
        letters = self.letters[self.starts[queries][:, None] + np.arange(size)]
        exact = np.broadcast_to(self._packed(np.ones(self.n, bool)), (len(queries), self.width)).copy()
        replaced, longer, shorter = (np.zeros_like(exact) for _ in range(3))
        for i in range(size):
            same, ahead = self.bits[self.rows[i, letters[:, i]]], self.bits[self.rows[i + 1, letters[:, i]]]
            replaced = (replaced & same) | (exact & ~same)
            longer = (longer | exact) & ahead
            if i:
                shorter &= self.bits[self.rows[i - 1, letters[:, i]]]
            shorter |= exact
            exact &= same
        found = replaced & self._packed(self.lengths == size)
        found |= (longer | exact) & self._packed(self.lengths == size + 1)
        found |= shorter & self._packed(self.lengths == size - 1)
        query, word = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : self.n])
        return queries[query], word


def _pairs_of_block(block: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
    """Near words of the same group; of a cut group, those of different parts or of the same one."""
    words = block.column("word").combine_chunks()
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    index = PositionIndex(letters, lengths)
    by_length = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[by_length])) + 1
    found = [index.near(q) for q in np.split(by_length, cuts) if len(q)]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    shorter, part, low, high = (block.column(c).to_numpy() for c in ("shorter", "part", "low", "high"))
    right = (group[a] == group[b]) & (np.minimum(lengths[a], lengths[b]) == shorter[a]) & ((low[a] == high[a]) | (part[a] != part[b]))
    a, b = a[right], b[right]
    if not len(a):
        return None
    n = block.column("n").combine_chunks()
    return pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), n.take(pa.array(b))], names=["word", "near", "near_n"])


def _found_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows that come group after group; small groups share an index."""

    def blocks(rows: pa.Table, last: bool) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
        """Whole blocks, then with None the rows of the groups that are not done."""
        key = rows.column("key").combine_chunks()
        low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
        change = pc.not_equal(key.slice(1), key.slice(0, max(len(key) - 1, 0))).to_numpy(zero_copy_only=False)
        change = change | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        group = np.repeat(np.arange(len(sizes)), sizes)
        done = np.ones(len(key), bool) if last else group < len(sizes) - 1
        kept = np.flatnonzero(done & (sizes[group] > 1))
        weight = pc.utf8_length(rows.column("word")).to_numpy().astype(np.int64) / BLOCK_LETTERS + 1 / BLOCK_WORDS
        total = np.cumsum(weight[kept])
        at = 0
        while at < len(kept):
            # Up to a full block, and on to the end of the group.
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + 1))
            to = int(np.searchsorted(group[kept], group[kept[min(to, len(kept) - 1)]], "right"))
            yield rows.take(pa.array(kept[at:to])), group[kept[at:to]]
            at = to
        yield rows.filter(pa.array(~done)), None

    waiting: list[pa.Table] = []
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in waiting) < 4 * BLOCK_WORDS:
            continue
        rows, waiting = pa.concat_tables(waiting).combine_chunks(), []
        for block, group in blocks(rows, last=False):
            if group is None:
                waiting = [block] if block.num_rows else []
            elif (pairs := _pairs_of_block(block, group)) is not None:
                yield pairs
    if waiting:
        for block, group in blocks(pa.concat_tables(waiting).combine_chunks(), last=True):
            if group is not None and (pairs := _pairs_of_block(block, group)) is not None:
                yield pairs


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: words (different ones, with their n) that one inserted, deleted or replaced letter sets apart.

    Both directions of a pair are given; a pair may come more than once.
    """
    size = F.length("word")
    keys = []
    for shorter in (size, size - 1):
        for j in range(PIECES):
            begin, end = F.expr("shorter * j div pieces"), F.expr("shorter * (j + 1) div pieces")
            keys.append(F.struct(shorter.alias("shorter"), F.lit(j).alias("j"), F.lit(PIECES).alias("pieces")))
    dealt = words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.*")
    head = F.substr("word", F.lit(1), begin)
    tail = F.substr("word", F.length("word") - (F.col("shorter") - end) + 1)
    dealt = dealt.select("word", "n", "shorter", F.concat_ws("|", "shorter", "j", head, tail).alias("key"))
    weight = F.ceil(F.sum(F.lit(1.0 / BLOCK_WORDS) + F.length("word") / F.lit(float(BLOCK_LETTERS)))).cast("int")
    large = written(dealt.groupBy("key").agg(weight.alias("parts")).where("parts > 1"), small=True)
    cut = dealt.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "shorter", "part", "word", "n")
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = paired.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return sorted_.mapInArrow(_found_pairs, "word string, near string, near_n long")


def noisy_words(docs: DataFrame, min_length: int = MIN_LENGTH, noise: int = NOISE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word: each run of letters, in lower case, some with a letter deleted by a hash of document and run.

    Only runs that may give min_length letters are looked at. A null id counts as the empty text.
    """
    run = RUNS.removesuffix("+") + f"{{{min_length},}}"
    runs = docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(f"`{text_column}`"), F.lit(run), F.lit(0))).alias("run"),
    ).withColumn("run", F.translate("run", _UPPER, _LOWER))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.expr("CAST(h % length(run) AS INT)")
    deleted = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % noise == 0, deleted).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= min_length)


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root of each word with a form, the forms followed to the last one.

    Forms are more frequent by a factor each time, so chains are short; each pass doubles what it follows.
    """
    links = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def group_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words and their counts n.

    The form is the near word with the largest n, ties to the smaller in code-point order, where that n
    is at least ratio times the word's own. An empty table gives none. Words with null are left out.
    """
    words = words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    # The near words of one word are few: an edit has a place and a letter.
    found = near_words(words).groupBy("word").agg(F.size(F.collect_set("near")).cast("long").alias("n_near"), best)
    joined = words.join(found, "word", "left")
    form_n = -F.col("best.minus")
    enough = form_n >= ratio * F.col("n")
    stats = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, form_n).alias("form_n"),
        )
    )
    roots = with_roots(stats.where("form IS NOT NULL"))
    return stats.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = FORM_RATIO,
    noise: int = NOISE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The words of all documents with their forms and roots, see group_variants.

    Null and empty texts have no words, repeated rows count as often as they stand there, other
    columns are ignored, an empty table gives no rows. Texts and words may have any length.
    """
    counted = noisy_words(docs, min_length, noise, id_column, text_column).groupBy("word").agg(F.count("*").alias("n"))
    return group_variants(written(counted.where(F.col("n") >= min_count)), ratio)
