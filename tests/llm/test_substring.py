import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tickertone.llm import fmindex, substring


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    counts = Counter(tuple(w[i : i + window]) for w in (words_of(t) for _, t in rows) for i in range(len(w) - window + 1))
    out = []
    for doc_id, text in rows:
        words = words_of(text)
        gone = {i + k for i in range(len(words) - window + 1) if counts[tuple(words[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), kept))
    return sorted(out, key=str)


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 3)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            at = r.randint(0, len(words))
            words[at:at] = passage[r.randint(0, 20) :]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(words)))
    rows += [(200 + i, rows[7][1]) for i in range(30)]
    rows += [(300, None), (301, ""), (302, "la " * 5000), (303, "x y z " * 40), (304, " ".join(passage[:35])), (305, " ".join(passage[:34])), rows[8], (None, rows[9][1]), (306, "w" * 50_000 + " " + " ".join(passage))]
    return rows


@pytest.mark.parametrize("window, options", [(35, {}), (35, {"hot_segments": 3, "shard_words": 2000}), (4, {"hot_segments": 5}), (1, {})])
def test_against_brute_force(docs, window, options):
    rows = corpus()
    found = substring.without_repeats(docs(rows), window, **options).collect()
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept) for r in found], key=str) == brute(rows, window)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in found)


def test_digests_and_empty_table(docs):
    rows = corpus()
    found = substring.without_repeats(docs(rows), digests=True).collect()
    expected = sorted([(i, hashlib.sha256(k.encode()).hexdigest()) for i, _, _, k in brute(rows, 35)], key=str)
    assert sorted([(r.id, r.kept_sha256) for r in found], key=str) == expected
    assert substring.without_repeats(docs([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=20), min_size=1, max_size=20), st.integers(2, 9), st.randoms(use_true_random=False))
def test_matching_statistics(sequences, window, random_):
    weights = np.array([random_.randint(1, 2) for _ in sequences])
    index = fmindex.FMIndex(np.concatenate(sequences).astype(np.uint64), np.array([len(s) for s in sequences]), weights, window)
    got = index.matching_statistics(2)
    counts = Counter()
    for s, weight in zip(sequences, weights, strict=True):
        for i in range(len(s) - window + 1):
            counts[tuple(s[i : i + window])] += weight
    for s, start in zip(sequences, index.starts, strict=True):
        assert [got[start + i] >= window for i in range(len(s) - window + 1)] == [counts[tuple(s[i : i + window])] >= 2 for i in range(len(s) - window + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=200))
def test_wavelet_ranks(values):
    _, sequence = np.unique(values, return_inverse=True)
    matrix = fmindex.WaveletMatrix(sequence, np.bincount(sequence))
    for symbol in set(sequence.tolist()):
        places = np.arange(len(sequence) + 1)
        ranks = matrix.rank(np.full(len(places), symbol), places)
        assert ranks.tolist() == [0, *np.cumsum(sequence == symbol).tolist()]


def test_equal_windows_of_a_hot_minimiser_are_one_entry(docs, monkeypatch):
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(30)] + passage + [f"z{i}_{k}" for k in range(30)])) for i in range(200)]
    dealt, marked = [], substring._marked

    def held(table, window):
        dealt.extend(table.collect())
        return marked(table, window)

    monkeypatch.setattr(substring, "_marked", held)
    found = substring.without_repeats(docs(rows), hot_segments=20, shard_words=200).collect()
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept) for r in found], key=str) == brute(rows, 35)
    texts = Counter(r.text for r in dealt)
    assert max(texts.values()) == 1
    shards = Counter()
    for r in dealt:
        shards[r.shard] += len(r.text.split())
    assert len(shards) > 1 and max(shards.values()) <= 1000
