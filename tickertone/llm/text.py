"""Words and hashes of words for whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: A word is a run of bytes outside these; UTF-8 keeps them apart from longer characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD, _ODD_WORDS = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Bytes hashed at once; bounds the eight-byte arrays below.
_BLOCK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values with all bits depending on all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)


def _power_tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < size at least."""
    known = _powers.get(base)
    if known is None or len(known[0]) < size:
        size = max(size, 1024) * 5 // 4
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        known = _powers[base] = tuple(both)
    return known


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about limit bytes of text each; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows together, and where each row begins; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of the first word of each row (one entry more than rows)."""
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1] | cut[1:-1]
    ends[:-1] &= space[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, the same in every batch."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        size = int(ends[to - 1] - base)
        power, inverse = _power_tables(_ODD, size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_CODES[data[base : base + size]] * power[:size], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mixed((total[e] - total[s]) * inverse[s])
        at = to
    return out


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive entries; runs may cross rows, callers leave those out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(_ODD_WORDS, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mixed((total[size:] - total[:n]) * inverse[:n])


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text, as two columns t1 and t2; copies of a text share them."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
