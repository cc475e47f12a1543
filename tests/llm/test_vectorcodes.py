import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tickertone.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % parts == 0]
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in kept]
    first = sorted([(i, v) for i, v, _ in kept if i is not None])
    if not first:
        return []
    kept = [r for r in kept if len(r[1]) == len(first[0][1])]
    first = [x for x in first if len(x[1]) == len(first[0][1])][:entries]
    d = len(first[0][1]) // parts
    cut = lambda v: [v[p * d : (p + 1) * d] for p in range(parts)]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        members = {}
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                members.setdefault((p, nearest(p, x)[1]), []).append(x)
        for (p, e), xs in members.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [(i, label, [nearest(p, x) for p, x in enumerate(cut(v))]) for i, v, label in kept]
    errors = {}
    for _, label, best in found:
        errors[label] = errors.get(label, 0) + sum(e for e, _ in best)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in best), sum(x for x, _ in best), errors[label], digest) for i, label, best in found]


def run(spark, rows, **more):
    found = vectorcodes.compressed(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA), **more)
    return sorted([tuple(r) for r in found.collect()], key=str)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 20), st.integers(1, 5), st.integers(0, 40), st.randoms(use_true_random=False))
def test_search_is_exact(entries, d, spread, random):
    """Small spreads give many ties of sums and of distances."""
    pick = lambda n: np.array([[random.randint(-spread, spread) for _ in range(d)] for _ in range(n)], np.int64)
    book, parts = pick(entries), pick(30)
    index, distance = vectorcodes.Codebook(book).nearest(parts)
    all_ = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()


def test_large_components():
    book = np.array([[1 << 27] * 8, [-(1 << 27)] * 8], np.int64)
    index, distance = vectorcodes.Codebook(book).nearest(-book)
    assert index.tolist() == [1, 0] and distance.tolist() == [0, 0]


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 16)], int(i) % 3 or None) for i in rng.permutation(120)]
    rows += [rows[5], rows[5]] + [(900 + i, rows[7][1], 1) for i in range(40)]  # repeated rows, equal vectors
    rows += [(-3, None, 1), (-2, [None] * 16, 1), (-4, [float("nan")] * 16, 1), (-5, [float("inf")] * 16, 1), (-6, [], 1), (-7, [0.5] * 15, 1)]
    rows += [(None, [0.25] * 16, None), (2000, [0.5] * 8, 1), (500, [0.0] * 16, 2), (501, [-1e-9] * 16, 2)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_few_rows(spark):
    rows = [(2, [0.5] * 8, None), (1, [0.25, -0.25] * 4, None)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_no_rows(spark):
    assert run(spark, []) == run(spark, [(1, None, 2)]) == run(spark, [(None, [0.5] * 8, 2)]) == []


def test_too_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e9] * 8, 1)])
