import collections
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tickertone.llm import spelling

SCHEMA = "word string, n long"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted([(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()], key=str)


def collected(df):
    return sorted([tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()], key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abÿ", min_size=0, max_size=7), min_size=1, max_size=90, unique=True))
def test_index_finds_all_near_words(words):
    lengths = np.array([len(w) for w in words])
    index = spelling.PositionIndex(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), lengths)
    found = set()
    for size in set(lengths.tolist()):
        a, b = index.near(np.flatnonzero(lengths == size))
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert found == {(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if one_apart(w, v)}


@pytest.mark.parametrize("block", [4, 1024])
def test_groups_against_brute_force(spark, monkeypatch, block):
    """Small blocks cut groups into parts, whose pairs are compared."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rng = np.random.default_rng(block)
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice(list("abcé"), rng.integers(7, 11)))
        for _ in range(6):
            at, letter = int(rng.integers(len(base))), str(rng.choice(list("abz")))
            variant = (base[:at] + letter + base[at + 1 :], base[:at] + base[at + 1 :], base[:at] + letter + base[at:])[int(rng.integers(3))]
            counts[variant] = int(10 ** rng.uniform(0.3, 4))
        counts[base] = int(10 ** rng.uniform(0.3, 5))
    counts["x" * 3000], counts["x" * 3001] = 2, 40
    found = collected(spelling.group_variants(spark.createDataFrame(list(counts.items()), SCHEMA)))
    assert found == brute(counts)
    assert any(row[1] and row[1] != row[2] for row in found)


def test_documents(spark, docs):
    rows = [(i, f"Spelling spelling7SPELLING ÉcolesÀ ecolesà été kurz {'n' * 50}{'m' * (i % 3)}") for i in range(400)]
    rows += [(400, None), (401, ""), (None, "spelling Spelling"), (7, rows[7][1]), (402, "spellinng spellinng ÷×÷×÷×÷ ÷×÷×÷×÷ " + "lettersofonelongword" * 2000)]
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert collected(spelling.spelling_variants(docs(rows))) == brute(counts)
    assert len(counts) > 8


def test_empty_tables(spark, docs):
    assert collected(spelling.spelling_variants(docs([]))) == []
    assert collected(spelling.group_variants(spark.createDataFrame([(None, 3)], SCHEMA))) == []
    assert collected(spelling.group_variants(spark.createDataFrame([("", 3), ("a", 30)], SCHEMA))) == brute({"": 3, "a": 30})
