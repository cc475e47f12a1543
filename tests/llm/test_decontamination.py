import hashlib
import random
import re

import pytest

from tickertone.llm import decontamination as deco

ITEMS = "item_id long, text string, doc_id string"


def words(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(rows, items, size=10):
    phrases = {}
    for item, text, *_ in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in {len(p) for p in phrases}:
                if i + n <= len(w) and tuple(w[i : i + n]) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[tuple(w[i : i + n])] - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(docs, spark, rows, items, **more):
    found = deco.contaminated(docs(rows), spark.createDataFrame(items, ITEMS), **more)
    return sorted([tuple(r) for r in found.collect()], key=str)


def test_edge_cases(spark, docs):
    run_of = "a b c d e f g h i j k l m n"
    items = [
        (1, run_of, "clash"), (2, "x y", None), (2, "hot hot hot", None), (3, "solo", None), (4, None, None), (5, " .,", None), (10, "C D E F G H I J K L", None),
        (None, "no id here", None), (7, "Ünder über", None), (7, "x y", None), (8, "absent words of no text", None),
    ]
    rows = [
        (0, None), (1, ""), (2, run_of), (3, "B.c-d e_f g h\x00i j k! " + run_of[:9]), (4, "x y x y"), (5, "hot " * 30), (6, "the solo SOLO"), (7, "a no id here z"),
        (8, "Ünder über under"), (8, "Ünder über under"), (None, "x y"), (9, "y x"), (10, run_of.upper() * 3), (11, "q " * 20_000 + run_of), (12, "under  über\nx;y"),
    ]
    assert run(docs, spark, rows, items) == brute(rows, items)


@pytest.mark.parametrize("size", [1, 3])
def test_random_texts(spark, docs, size):
    rng = random.Random(size)
    letters = "aaaaaaaabbbcde"
    rows = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(rng.randint(0, 9), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 15))), None) for _ in range(12)]
    assert run(docs, spark, rows, items, size=size) == brute(rows, items, size)


def test_empty_tables(spark, docs):
    assert run(docs, spark, [], [(1, "a b", None)]) == []
    assert run(docs, spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_proximity(spark, docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(99, None)]
    items = [(1, "a b c", None), (2, "h h g", None), (3, "z a", None)]
    expected = set()
    for doc, text in rows:
        w = words(text)
        for item, phrase, _ in items:
            terms = set(words(phrase))
            expected |= {(doc, item, i + 1) for i in range(len(w)) if w[i] in terms and terms <= set(w[i : i + 5])}
    found = deco.proximity_matches(docs(rows), spark.createDataFrame(items, ITEMS), within=5)
    assert sorted((r.doc_id, r.item, r.begin) for r in found.collect()) == sorted(expected)


def test_plain_functions_only(spark, docs):
    """No Python worker in the plan of the result."""
    plan = deco.contaminated(docs([(1, "a b")]), spark.createDataFrame([(1, "a b", None)], ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan
