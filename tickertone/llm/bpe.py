"""BPE encoding and decoding by a pair occurrence index.

Words of a batch are laid out in one array of symbols. An index maps each mergeable pair to the
positions where it stands, over all words of the batch. A heap gives the active ranks in ascending
order; a rank is applied to all its positions at once, and the lists of the pairs that this makes
are extended. Each word sees its merges in the order it would see them alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tickertone.llm.shared import sets_aside
from tickertone.llm.text import pieces

#: Python counts these as white space, Unicode does not.
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
_WHITE = regex.compile(r"\p{White_Space}+")
_NO_RANK = np.iinfo(np.int32).max
#: Bytes of text whose words are indexed together.
CHUNK = 32 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 on for the others, in order."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Tables of a word-end BPE file: lower case, NFC, byte symbols, the last symbol of a word marked."""

    tokens: list[str]
    ranks: np.ndarray  # of the pairs, in the order of their keys
    keys: np.ndarray  # left * size + right, ascending
    merged: np.ndarray  # id that a pair becomes
    inner: np.ndarray  # id of a byte within a word
    final: np.ndarray  # id of a byte that ends a word
    special: dict[str, int]
    words: regex.Pattern
    specials: regex.Pattern | None

    @classmethod
    def load(cls, file: str) -> Vocabulary:
        with open(file, encoding="utf-8") as source:
            return cls.parse(source.read())

    @classmethod
    def parse(cls, content: str) -> Vocabulary:
        table = json.loads(content)
        model = table["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in table["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, at in (ids | special).items():
            tokens[at] = token
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([ids[p[side]] for p in pairs], np.int64) for side in (0, 1))
        keys = left * len(tokens) + right
        order = np.argsort(keys, kind="stable")
        letters = byte_characters()
        pattern = next(x["pattern"]["Regex"] for x in table["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        return cls(
            tokens=tokens,
            ranks=order.astype(np.int32),
            keys=keys[order],
            merged=np.array([ids[a + b] for a, b in pairs], np.int32)[order],
            inner=np.array([ids[x] for x in letters], np.int32),
            final=np.array([ids[x + suffix] for x in letters], np.int32),
            special=special,
            words=regex.compile(pattern.replace(r"\s", r"\p{White_Space}")),
            specials=regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None,
        )

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; pairs with a negative side or without a merge have no rank."""
        keys = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], _NO_RANK).astype(np.int32), self.merged[at]

    def runs(self, text: str) -> list[str | tuple[str]]:
        """Lower-case runs between white space; a special token is a run of its own, a tuple of its text."""
        out: list[str | tuple[str]] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append((part,))
                continue
            # One character at a time: the sigma that ends a word has no form of its own here.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += part.split() if _SEPARATORS.isdisjoint(part) else _WHITE.split(part)
        return out

    def pretokens(self, run: str | tuple[str]) -> list[str | tuple[str]]:
        """The words of a run; no word holds white space, so a run is cut alike in every text."""
        return [run] if isinstance(run, tuple) else self.words.findall(run)


class _Numbers(dict):
    """String to its number, in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


def _sorted_once(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _gather(row: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all entries of the numbered lists in row, one list after the other."""
    size = lengths[row]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[row] - (ends - size), size)


def encode_words(words: list[str | tuple[str]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and where each word begins (one entry more than words)."""
    raw = [b"\0" if isinstance(w, tuple) else w.encode() for w in words]
    lengths = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = len(data)
    symbol = np.full(n + 1, -1, np.int32)  # the last entry stands for no neighbour
    symbol[:n] = vocabulary.inner[data]
    symbol[ends - 1] = vocabulary.final[data[ends - 1]]
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    after[ends - 1] = n
    before[starts] = n
    before[n] = after[n] = n
    for at in [i for i, w in enumerate(words) if isinstance(w, tuple)]:
        symbol[starts[at]] = vocabulary.special[words[at][0]]

    rank_at, _ = vocabulary.lookup(symbol[:n], symbol[after[:n]])
    rank_at = np.append(rank_at, _NO_RANK).astype(np.int32)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = [0, *cuts.tolist()]
        for rank, a, b in zip(ranks[firsts].tolist(), firsts, [*firsts[1:], len(ranks)], strict=True):
            if rank not in index:
                index[rank] = []
                heapq.heappush(active, rank)
            index[rank].append(positions[a:b])

    live = np.flatnonzero(rank_at != _NO_RANK)
    if len(live):
        add(rank_at[live], live)
    by_rank = np.empty(len(vocabulary.ranks), np.int64)
    by_rank[vocabulary.ranks] = np.arange(len(vocabulary.ranks))
    while active:
        rank = heapq.heappop(active)
        at = np.concatenate(index.pop(rank))
        at = at[rank_at[at] == rank]  # others have merged since
        if not len(at):
            continue
        pair = by_rank[rank]
        left, right = divmod(int(vocabulary.keys[pair]), len(vocabulary.tokens))
        at = _sorted_once(at)
        if left == right:  # of overlapping positions the first counts
            kept, taken = [], -1
            for p in at.tolist():
                if p != taken:
                    kept.append(p)
                    taken = int(after[p])
            at = np.array(kept)
        gone = after[at]
        symbol[at] = vocabulary.merged[pair]
        symbol[gone] = -1
        rank_at[gone] = _NO_RANK
        after[at] = after[gone]
        before[after[at]] = at
        before[n] = n
        changed = np.concatenate([before[at], at])
        changed = _sorted_once(changed[changed < n])
        ranks, _ = vocabulary.lookup(symbol[changed], symbol[after[changed]])
        rank_at[changed] = ranks
        found = ranks != _NO_RANK
        if found.any():
            add(ranks[found], changed[found])
    left_over = symbol[:n] >= 0
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.add.reduceat(left_over, starts, dtype=np.int64) if n else [], out=offsets[1:])
    return symbol[:n][left_over], offsets


def encode_texts(texts: list[str | None], vocabulary: Vocabulary) -> tuple[list[np.ndarray], list[str]]:
    """Ids and decoded text of each text; null counts as empty."""
    numbers, words = _Numbers(), _Numbers()
    rows = [np.fromiter(map(numbers.__getitem__, vocabulary.runs(t or "")), np.int64) for t in texts]
    in_runs = [[words[w] for w in vocabulary.pretokens(run)] for run in numbers]
    if not words:
        return [np.zeros(0, "<u4") for _ in rows], ["" for _ in rows]
    word_ids, offsets = encode_words(list(words), vocabulary)
    # Ids and decoded text of each run, then of each text.
    sizes = np.fromiter(map(len, in_runs), np.int64, len(in_runs))
    flat = np.fromiter((w for run in in_runs for w in run), np.int64)
    ids = word_ids[_gather(flat, offsets, np.diff(offsets))].astype("<u4")
    run_lengths = np.zeros(len(in_runs) + 1, np.int64)
    token_ends = np.append(0, np.cumsum(np.diff(offsets)[flat]))
    run_lengths[1:] = token_ends[np.cumsum(sizes)]
    starts, lengths = run_lengths[:-1], np.diff(run_lengths)
    tokens = vocabulary.tokens
    strings = [" ".join([tokens[i] for i in ids[a:b].tolist()]) for a, b in zip(run_lengths[:-1], run_lengths[1:], strict=True)]
    out = [ids[_gather(row, starts, lengths)] for row in rows]
    return out, [" ".join([s for s in map(strings.__getitem__, row.tolist()) if s]) for row in rows]


@sets_aside(r"__.*")
def encode(docs: DataFrame, file: str, text: str = "text", digests: bool = False) -> DataFrame:
    """All columns but the text, with ids (array of int) and decoded (string), or their digests.

    A null text counts as empty and gives no ids. Every row gives one row, repeated rows too. A
    column of the input named as one of the output is replaced. With digests the columns are
    n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256.
    The vocabulary is bounded by its file, which the driver reads once; memory of a task is bounded
    by one chunk of texts or one text.
    """
    with open(file, encoding="utf-8") as source:
        content = source.read()
    added = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else ["ids array<int>", "decoded string"]
    names = {x.split(" ")[0] for x in added}
    kept = [c for c in docs.columns if c not in names and c != text]
    marked = docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in kept])
    fields = [f.simpleString().split(":", 1) for f in marked.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for whole in batches:
            vocabulary = vocabulary or Vocabulary.parse(content)
            for batch in pieces(whole, "__text", CHUNK):
                ids, decoded = encode_texts(batch.column("__text").to_pylist(), vocabulary)
                if digests:
                    new = [
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    ]
                else:
                    new = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                columns = [batch.column(i) for i in range(1, batch.num_columns)] + new
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[x.split(" ")[0] for x in added]])

    schema = ", ".join([f"`{name}` {kind}" for name, kind in fields] + added)
    return marked.mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """Tokens joined by one space, special ones included."""
    return " ".join(vocabulary.tokens[i] for i in ids)
