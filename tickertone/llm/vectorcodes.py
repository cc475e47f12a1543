"""Product codes of vectors, their codebooks trained by integer k-means with equal-average search.

For a part x and an entry c of d components, (sum x - sum c) ** 2 / d is at most their squared
distance. The entries of a codebook stand in the order of their sums; the search begins beside the
sum of x, goes outward on the nearer side, and ends when that bound strictly exceeds the best
distance on both sides, so that an entry as near with a lower index is never passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickertone.llm.shared import written
from tickertone.llm.topk import is_finite, scaled

#: Fixed values of the contract.
FACTOR, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bound of a scaled component times the length of a part, for which squared gaps and distances fit 64 bits.
LARGEST = 1 << 30
#: Parts searched at once; bounds the arrays of a task.
STEP = 1 << 16


class Codebook:
    """Entries of one part position, in the order of their component sums (equal sums by index)."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.lexsort((np.arange(len(entries)), sums))
        self.entries, self.sums = entries[self.order], sums[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, ties to the lower, and the squared distance."""
        n, d = parts.shape
        sums = parts.sum(axis=1)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        best = np.full(n, np.iinfo(np.int64).max)
        index = np.full(n, len(self.entries))
        rows = np.arange(n)
        far = np.iinfo(np.int64).max
        while len(rows):
            u, w = up[rows], down[rows]
            gap_up = np.where(u < len(self.sums), np.abs(self.sums[np.minimum(u, len(self.sums) - 1)] - sums[rows]), far)
            gap_down = np.where(w >= 0, np.abs(sums[rows] - self.sums[np.maximum(w, 0)]), far)
            gap = np.minimum(gap_up, gap_down)
            # gap ** 2 > d * best, with the product kept within 64 bits.
            open_ = (gap < far) & ((index[rows] == len(self.entries)) | (gap * gap <= d * np.minimum(best[rows], far // d)))
            rows, u, w, upward = rows[open_], u[open_], w[open_], (gap_up <= gap_down)[open_]
            entry = np.where(upward, u, w)
            distance = ((parts[rows] - self.entries[entry]) ** 2).sum(axis=1)
            number = self.order[entry]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < index[rows]))
            best[rows[better]], index[rows[better]] = distance[better], number[better]
            up[rows[upward]] += 1
            down[rows[~upward]] -= 1
        return index, best


def _quantised(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and rows of the vectors, a bounded number at a time."""
    step = max(STEP // max(width, 1), 1)
    for at in range(0, batch.num_rows, step):
        some = batch.column("q").slice(at, step)
        yield at, np.asarray(some.flatten(), np.int64).reshape(len(some), width)


def _sums(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Component sums and, last, the number of the parts nearest to each entry: parts x entries x (d + 1)."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        total = np.zeros((parts, entries, d + 1), np.int64)
        for batch in batches:
            for _, values in _quantised(batch, parts * d):
                for p, book in enumerate(searched):
                    x = values[:, p * d : (p + 1) * d]
                    index, _ = book.nearest(x)
                    np.add.at(total[p], index, np.c_[x, np.ones(len(x), np.int64)])
        p, e = np.nonzero(total[:, :, d])
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["p", "e", "s"])

    each = rows.select("q").mapInArrow(run, "p int, e int, s array<long>")
    summed = each.groupBy("p", "e").agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(d + 1)])
    total = np.zeros((parts, entries, d + 1), np.int64)
    for row in summed.collect():  # at most parts x entries rows
        total[row.p, row.e] = row[2:]
    return total


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks parts x entries x d of the table made by quantised_rows.

    Each round is a scan that leaves a sum for each entry and task; the codebooks, which do not grow
    with the table, are all that reaches the driver.
    """
    seeds = rows.where("id IS NOT NULL").orderBy("id", "q").select("q").limit(entries).collect()
    values = np.array([r.q for r in seeds], np.int64)
    books = values.reshape(len(seeds), parts, -1).swapaxes(0, 1).copy()
    for _ in range(rounds):
        total = _sums(rows, books)
        count = total[:, :, -1:]
        books = np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)
    return books


def quantised_rows(vectors: DataFrame, parts: int = PARTS, factor: int = FACTOR, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """id, label, q of the rows that take part, written once; q holds floor(factor * x)."""
    vector = F.col(f"`{vector_column}`")
    q = F.when(is_finite(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0), scaled(vector, factor))
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").alias("label"), q.alias("q")).where("q IS NOT NULL")
    large = F.exists("q", lambda x: F.abs(x) > LARGEST * parts / F.size("q"))
    checked = F.when(large, F.raise_error(F.lit("a component is too large for exact distances in 64 bits"))).otherwise(F.col("q"))
    rows = written(rows.withColumn("q", checked))
    first = rows.where("id IS NOT NULL").select("id", F.size("q").alias("size"), "q").orderBy("id", "q").first()
    return rows.where(F.size("q") == (first.size if first else -1))


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each row of quantised_rows."""
    parts, _, d = books.shape
    layout = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        for batch in batches:
            for at, values in _quantised(batch, parts * d):
                found = [book.nearest(values[:, p * d : (p + 1) * d]) for p, book in enumerate(searched)]
                codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                text = [c.tobytes().hex() for c in codes]
                error = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(codes)), batch.column("label").slice(at, len(codes)), pa.array(text), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return rows.mapInArrow(run, layout)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    factor: int = FACTOR,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector.

    Components become floor(factor * x). Rows whose vector is null, empty or holds null or non-finite
    components take no part, nor do those whose length parts does not divide or is not the length of
    the first row by id. The codebooks start as the rows with the smallest ids, equal ids in the order
    of their components; rows with a null id are coded but never start one (alone, they have no
    codebook and give no rows). Repeated rows count and come back as often as they stand there. With
    fewer rows than entries the codebooks are shorter. Nulls are one label. Other columns are ignored;
    an empty table gives no rows. A scaled component beyond 2 ** 30 / (length of a part) is an error. At
    most 256 entries.
    """
    rows = quantised_rows(vectors, parts, factor, id_column, vector_column, label_column)
    if rows.isEmpty():
        coded = vectors.sparkSession.createDataFrame([], f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")
        digest = None
    else:
        books = train(rows, parts, entries, rounds)
        digest = books_digest(books)
        coded = written(encode(rows, books))
    # Written, so that its size is known: sent to all tasks if small, else a hot label's rows can be split.
    by_label = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), small=True)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
