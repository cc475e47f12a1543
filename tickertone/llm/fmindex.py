"""Compressed FM-index over word sequences: matching statistics by backward search over a wavelet matrix.

The suffix array orders suffixes by their first words only, as many as a window needs; for patterns
up to that length the intervals of backward search are the same as with a full suffix array. The
wavelet matrix stores each symbol with a code of about log2(n / count) bits, so its size follows the
entropy of the words. All steps work on many sequences at once.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Counts of a symbol before a position, over a sequence of symbols 0 .. n_symbols - 1 that all occur."""

    def __init__(self, sequence: np.ndarray, counts: np.ndarray):
        n = len(sequence)
        lengths = np.maximum(np.ceil(np.log2(n / counts)).astype(np.int64), 1)
        # Shorter codes first; at each level the symbols that end take the last nodes, so that the rest keep their places.
        order = np.argsort(lengths, kind="stable")
        ends = np.searchsorted(lengths[order], np.arange(lengths.max() + 2))
        codes = np.zeros(len(counts), np.int64)
        nodes = np.zeros(1, np.int64)
        for depth in range(1, int(lengths.max()) + 1):
            nodes = np.concatenate([nodes * 2, nodes * 2 + 1])
            done = order[ends[depth] : ends[depth + 1]]
            longer = lengths[order[ends[depth + 1] :]]
            needed = int(np.ceil(np.sum(0.5 ** (longer - depth)))) if len(longer) else 0
            nodes = nodes[: needed + len(done)]
            codes[done] = nodes[needed:]
            nodes = nodes[:needed]
        self.lengths, self.codes = lengths, codes
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for depth in range(int(lengths.max())):
            bits = ((codes[sequence] >> (lengths[sequence] - 1 - depth)) & 1).astype(bool)
            packed = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            ones = np.bitwise_count(packed).astype(np.int32)
            self.before.append(np.cumsum(ones, dtype=np.int32) - ones)
            self.zeros.append(int(len(bits) - bits.sum()))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
            sequence = sequence[: len(sequence) - int(np.sum(counts[lengths == depth + 1]))]
        symbols = np.arange(len(counts))
        self.base = self._descend(symbols, np.zeros(len(counts), np.int64))

    def _descend(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        out = np.empty(len(symbols), np.int64)
        left = self.lengths[symbols]
        codes, at, where = self.codes[symbols], positions, np.arange(len(symbols))
        for words, before, zeros in zip(self.words, self.before, self.zeros, strict=True):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            left = left - 1
            at = np.where((codes >> left) & 1, zeros + ones, at - ones)
            over = left == 0
            if over.any():
                out[where[over]] = at[over]
                going = ~over
                codes, left, at, where = codes[going], left[going], at[going], where[going]
                if not len(where):
                    break
        return out

    def rank(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        return self._descend(symbols, positions) - self.base[symbols]


class FMIndex:
    """Index of word sequences, each with a weight that counts its copies."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray, window: int):
        self.window, self.lengths = window, lengths
        _, symbols = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths + 1)
        self.starts = ends - lengths - 1
        n = int(ends[-1])
        text = np.zeros(n, np.int64)  # 0 closes a sequence
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        text[inside] = symbols + 1
        self.text = text
        ranks, size = [text], 1
        while size <= window:
            last = ranks[-1]
            following = np.zeros(n, np.int64)
            following[: max(n - size, 0)] = last[size:] + 1
            _, rank = np.unique(last * (int(last.max()) + 2) + following, return_inverse=True)
            ranks.append(rank)
            size *= 2
        suffixes = np.argsort(ranks[-1], kind="stable")
        self.common = self._common(ranks[:-1], suffixes)
        counts = np.bincount(text)
        self.first = np.cumsum(counts) - counts
        self.weight = np.zeros(n + 1, np.int64)
        np.cumsum(np.repeat(weights, lengths + 1)[suffixes], out=self.weight[1:])
        self.wavelet = WaveletMatrix(text[suffixes - 1], counts)
        # Interval of the first window - 1 words at each place.
        cut = self.common < window - 1
        places = np.arange(n + 1)
        self.group_start = np.maximum.accumulate(np.where(cut, places, 0))
        self.group_end = np.minimum.accumulate(np.where(cut, places, n)[::-1])[::-1]
        self.least = [self.common]  # least[k][i]: minimum over the 2 ** k entries that end at i
        while 1 << len(self.least) <= n:
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            more = last.copy()
            more[step:] = np.minimum(last[step:], last[:-step])
            more[:step] = 0
            self.least.append(more)

    @staticmethod
    def _common(ranks: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
        """Words that neighbouring suffixes share, one entry for each border between suffixes."""
        n = len(suffixes)
        out = np.zeros(n + 1, np.uint8)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        shared = np.zeros(n - 1, np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            rank = ranks[level]
            same = (a < n) & (b < n)
            same[same] = rank[a[same]] == rank[b[same]]
            step = np.where(same, 1 << level, 0)
            a, b, shared = a + step, b + step, shared + step
        out[1:n] = np.minimum(shared, 255)
        return out

    def _widened(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of all suffixes that share depth words with those of an interval."""
        n = len(self.text)
        low, high, inner = low.copy(), high.copy(), depth > 0
        for level in range(len(self.least) - 1, -1, -1):
            table, step = self.least[level], 1 << level
            jump = inner & (table[low] >= depth)
            low[jump] -= step
            to = np.minimum(high + step - 1, n)
            jump = inner & (high + step - 1 <= n) & (table[to] >= depth)
            high[jump] += step
        return np.where(inner, low, 0), np.where(inner, high, n)

    def matching_statistics(self, least_weight: int = 2) -> np.ndarray:
        """For each word of each sequence, the most words from there on, window at most, that weigh least_weight in the index.

        Sequences run from their last word to their first, all at once. One that can no longer hold
        a whole window is left; its remaining entries are 0.
        """
        n, window = len(self.text), self.window
        out = np.zeros(n, np.int16)
        running = np.flatnonzero(self.lengths >= window)
        place = self.lengths[running] - 1
        low, high = np.zeros(len(running), np.int64), np.full(len(running), n, np.int64)
        length = np.zeros(len(running), np.int64)
        while len(running):
            full = length == window
            length = length - full
            low, high = np.where(full, self.group_start[low], low), np.where(full, self.group_end[high], high)
            symbol = self.text[self.starts[running] + place]
            todo = np.arange(len(running))
            new_low, new_high, new_length = np.zeros_like(low), np.full_like(high, n), np.zeros_like(length)
            while len(todo):
                c = symbol[todo]
                both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low[todo], high[todo]]))
                a, b = self.first[c] + both[: len(todo)], self.first[c] + both[len(todo) :]
                good = self.weight[b] - self.weight[a] >= least_weight
                hit = todo[good]
                new_low[hit], new_high[hit], new_length[hit] = a[good], b[good], length[hit] + 1
                todo = todo[~good]
                # A shorter right context, unless there is none left or no window could follow.
                todo = todo[(length[todo] > 0) & (place[todo] + length[todo] >= window)]
                if len(todo):
                    depth = np.maximum(self.common[low[todo]], self.common[high[todo]]).astype(np.int64)
                    depth = np.minimum(depth, length[todo] - 1)
                    low[todo], high[todo] = self._widened(low[todo], high[todo], depth)
                    length[todo] = depth
            low, high, length = new_low, new_high, new_length
            out[self.starts[running] + place] = length
            place = place - 1
            going = (place >= 0) & (place + 1 + length >= window)
            running, place, low, high, length = running[going], place[going], low[going], high[going], length[going]
        return out
