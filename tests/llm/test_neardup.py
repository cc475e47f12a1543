import random
import re
from fractions import Fraction

import pytest

from tickertone.llm import components, neardup


def gram_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    by_set = {}
    for doc_id, text in rows:
        by_set.setdefault(gram_set(text), []).append(doc_id)
    sets = [s for s in by_set if s]
    links = {s: [t for t in sets if t is not s and len(s & t) * 5 >= 4 * len(s | t)] for s in sets}
    out = []
    for doc_id, text in rows:
        own = gram_set(text)
        if not own:
            out.append((doc_id, doc_id, 1, 0, 0))
            continue
        reached, todo = {own}, [own]
        while todo:
            for other in links[todo.pop()]:
                if other not in reached:
                    reached.add(other)
                    todo.append(other)
        first = min((x for s in reached for x in by_set[s] if x is not None), default=None)
        out.append((doc_id, first, len(by_set[own]), len(links[own]), sum(len(by_set[t]) for t in links[own]) + len(by_set[own]) - 1))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):  # a hot group of near copies at many distances
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(word() for _ in range(60))) for i in range(60)]
    rows += [(300 + i, rows[170][1] + " tail" * (i % 2)) for i in range(40)]  # copies
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "two one"), (405, "one  two"), (406, "a a a a a a a a"), (407, "a a a a a"), (408, "x y " * 9000), (409, "x y " * 9000 + "z")]
    return [*rows, rows[3], (None, rows[4][1])]


@pytest.mark.parametrize("blocks", [{}, {"block_classes": 16}, {"block_grams": 2000}])
def test_against_brute_force(docs, blocks):
    rows = corpus()
    found = neardup.near_duplicates(docs(rows), **blocks).collect()
    assert sorted([(r.id, r.class_id, r.copies, r.n_linked_texts, r.n_links) for r in found], key=str) == brute(rows)


def test_first_of_each_group(docs):
    rows = corpus()
    table = docs(rows)
    stayed = neardup.first_of_each_group(table)
    assert stayed.columns == table.columns
    assert sorted(r.doc_id for r in stayed.collect()) == sorted({x[1] for x in brute(rows)})


def test_empty_table(docs):
    assert neardup.near_duplicates(docs([])).collect() == []
    assert neardup.first_of_each_group(docs([])).collect() == []


def test_band_shape():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = neardup.band_shape(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= neardup.RECALL and bands * rows <= neardup.MAX_HASHES
    assert neardup.band_shape(1.0) == (1, neardup.MAX_HASHES)
    with pytest.raises(ValueError):
        neardup.band_shape(0.1, 0.9999, 64)


def test_large_groups_verify_as_small_ones():
    import numpy as np

    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    got = neardup.links_within(sets, None, Fraction(2, 5))
    assert {(i, j) for i, j in np.argwhere(got).tolist()} == {(i, j) for i in range(40) for j in range(40) if i != j and 5 * len(set(sets[i]) & set(sets[j])) >= 2 * len(set(sets[i]) | set(sets[j]))}


def test_a_link_counts_under_its_least_label():
    before = neardup.met_before(5, [[5], [5, 2], [5, 2, 9], [5, 9], [5, 1]])
    assert [(i, j) for i in range(5) for j in range(i + 1, 5) if before[i, j]] == [(1, 2)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 520)] + [(9, 9)] + [(600, 600 + i) for i in range(1, 80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "u long, v long")
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {(x.node, x.root) for x in components.components(table).collect()} == {(x, find(x)) for x in linked}
