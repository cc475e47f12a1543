import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tickertone.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k=5, step=50):
    clean = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean.setdefault((i, tuple(math.floor(256 * np.float32(x).astype(float)) for x in v)))
    out = set()
    for q, a in clean:
        if q % step == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in clean if i != q and len(a) == len(b))[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 3), st.integers(1, 300), st.randoms(use_true_random=False))
def test_index_selects_exactly(n, width, dropped, spread, random):
    values = np.array([[random.randint(-spread, spread) for _ in range(width)] for _ in range(n)])
    ids = np.array(random.sample(range(100), n))
    index = topk.BitSlicedIndex(ids, values, dropped)
    query, own = values[0], int(ids[0])
    got = list(zip(*(x.tolist() for x in index.top(query, 3, own)), strict=True))
    assert got == [(i, -s) for s, i in sorted((-int(v @ query), i) for v, i in zip(values, ids.tolist(), strict=True) if i != own)[:3]]


@pytest.mark.parametrize("block_rows", [7, 16_384])
def test_against_brute_force(spark, block_rows):
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.normal(0, 0.2, 6)], 1) for i in range(260)]
    rows += [(1000 + i, rows[3][1], 2) for i in range(20)]  # ties
    rows += [(50, rows[50][1], 7)]  # a repeated row
    rows += [(400, None, 0), (401, [None] * 6, 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] * 6, 0), (None, [0.1] * 6, 0), (450, [0.5, 0.5], 0), (500, [0.0] * 6, 0), (550, [], 0)]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), block_rows=block_rows)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == sorted(brute(rows))


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []
