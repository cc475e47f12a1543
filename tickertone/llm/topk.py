"""Exact top-k inner products over a bit-sliced index.

The rows of a block are held as bitmaps: slice j of attribute d has a bit for each row, bit j of its
quantised value. A query adds the slices with carry-save bitmap arithmetic, once for each non-zero
signed binary digit of its own attribute, which gives the slices of the approximate score. The best
rows are selected from the most significant slice downward; rows whose score may lie on the right
side of the boundary, given what quantisation dropped, are resolved by exact integer products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows of one index; a task holds one.
BLOCK_ROWS = 16_384
#: Low bits of an attribute that the index leaves out.
DROPPED_BITS = 2


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, computed in double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))


def is_finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class BitSlicedIndex:
    """Bitmaps of a block of integer vectors, one row of values for each vector."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, dropped: int = DROPPED_BITS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.n, self.width = values.shape
        self.low = int(self.values.min()) if values.size else 0
        span = int(self.values.max()) - self.low if values.size else 0
        self.dropped = min(dropped, max(span.bit_length() - 1, 0))
        self.bits = max(span >> self.dropped, 1).bit_length()
        self.words = -(-self.n // 64)
        above = (self.values - self.low) >> self.dropped
        # slices[d, j]: bit j of attribute d, packed by row.
        self.slices = np.stack([self._packed(((above >> j) & 1).T) for j in range(self.bits)], axis=1)

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros((*bits.shape[:-1], self.words * 64), np.uint8)
        padded[..., : self.n] = bits
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum over attributes of query times quantised value, plus a constant.

        A negative digit adds the complement of a slice, which differs from the negative by a constant.
        """
        terms: dict[int, list[np.ndarray]] = {}
        rest, weight = query.astype(np.int64), 0
        while rest.any():
            digit = np.where(rest & 1, 2 - (rest & 3), 0)  # -1, 0 or 1: no two neighbours are non-zero
            rest = (rest - digit) >> 1
            plus, minus = self.slices[digit > 0], self.slices[digit < 0]
            for j in range(self.bits):
                terms.setdefault(weight + j, []).extend([plus[:, j], ~minus[:, j]])
            weight += 1
        out: list[np.ndarray] = []
        at = 0
        while at <= max(terms, default=-1):
            column = np.concatenate(terms.pop(at, None) or [np.zeros((0, self.words), np.uint64)])
            while len(column) > 1:
                third = max(len(column) // 3, 1)
                a, b = column[:third], column[third : 2 * third]
                either = a ^ b
                if len(column) == 2:
                    total, carry, left = either, a & b, column[2:]
                else:
                    c = column[2 * third : 3 * third]
                    total, carry, left = either ^ c, (a & b) | (c & either), column[3 * third :]
                terms.setdefault(at + 1, []).append(carry)
                column = np.concatenate([total, left]) if len(left) else total
            out.append(column[0] if len(column) else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to the smaller id; rows with the id own are left out."""
        exists = np.ones(self.n, bool)
        if own is not None:
            exists[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = False
        everyone = self._packed(exists[None].astype(np.uint8))[0]
        rows = np.flatnonzero(exists)
        if len(rows) > k and self.width and query.any():
            slices = self.score_slices(query)
            # Most significant slice first: sure rows, and rows level with the boundary so far.
            sure, level, boundary = np.zeros_like(everyone), everyone, 0
            for j in range(len(slices) - 1, -1, -1):
                ahead = sure | (level & slices[j])
                if int(np.bitwise_count(ahead).sum()) >= k:
                    level, boundary = level & slices[j], boundary | (1 << j)
                else:
                    sure, level = ahead, level & ~slices[j]
            # Each dropped remainder is below 2 ** dropped, so two scores may be off by this much against each other.
            slack = ((1 << self.dropped) - 1) * int(np.abs(query).sum()) >> self.dropped
            rows = self._rows(self._at_least(slices, everyone, boundary - slack - 1))
        scores = self.values[rows] @ query.astype(np.int64)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]

    @staticmethod
    def _at_least(slices: list[np.ndarray], everyone: np.ndarray, bound: int) -> np.ndarray:
        if bound <= 0:
            return everyone
        above, level = np.zeros_like(everyone), everyone
        for j in range(len(slices) - 1, -1, -1):
            if bound >> j & 1:
                level = level & slices[j]
            else:
                above, level = above | (level & slices[j]), level & ~slices[j]
        return above | level


def top_k(
    vectors: DataFrame,
    k: int = 5,
    query_step: int = 50,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    factor: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by query_step.

    Vectors are compared as integers floor(factor * x) by inner product; ties go to the smaller id.
    Rows with a null id, a null vector or null or non-finite components take no part. Repeated rows
    count once, and all rows of one id count as that id's own row. Only vectors of equal length are
    compared. Other columns are ignored. Inner products must fit 64 bits.

    Rows are dealt into blocks by a hash of the id and never copied; each query goes to every block
    of its length, which is the stated query set against all rows, in blocks. A task holds one block
    and meets its queries one batch at a time.
    """
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.when(is_finite(F.col(f"`{vector_column}`")), scaled(F.col(f"`{vector_column}`"), factor)).alias("vector"),
    )
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL").dropDuplicates(["id", "vector"])
    rows = rows.withColumn("size", F.size("vector"))
    blocks = max(1, -(-rows.count() // block_rows))
    queries = rows.where(F.col("id") % query_step == 0)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    parts = rows.withColumns({"block": block, "is_query": F.lit(False)}).unionByName(
        queries.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "is_query": F.lit(True)})
    )
    dealt = parts.repartition("size", "block").sortWithinPartitions("size", "block", "is_query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, index = [], None, None
        for batch in batches:
            sizes, ids, numbers, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "id", "block", "is_query"))
            vectors_ = batch.column("vector")
            cuts = np.flatnonzero((sizes[1:] != sizes[:-1]) | (numbers[1:] != numbers[:-1]) | (marks[1:] != marks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                size = int(sizes[a])
                values = np.asarray(vectors_.slice(a, b - a).flatten(), np.int64).reshape(b - a, size)
                if (size, numbers[a]) != key:
                    held, key, index = [], (size, numbers[a]), None
                if not marks[a]:
                    held.append((ids[a:b], values))
                    continue
                if index is None and held:
                    index = BitSlicedIndex(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held = []
                if index is None:
                    continue
                found = [index.top(v, k, own=q) for q, v in zip(ids[a:b].tolist(), values, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[a:b], [len(x) for x, _ in found])),
                        pa.array(np.concatenate([x for x, _ in found])),
                        pa.array(np.concatenate([x for _, x in found])),
                        pa.array(np.repeat(np.full(b - a, size, np.int32), [len(x) for x, _ in found])),
                    ],
                    names=["query_id", "vec_id", "score", "size"],
                )

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long, size int")
    # k rows of each block remain for a query; a window limit keeps k of each task before the shuffle.
    order = "PARTITION BY query_id, size ORDER BY score DESC, vec_id"
    ranked = found.selectExpr("query_id", f"row_number() OVER ({order}) AS rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
