import pytest
from pyspark.sql import functions as F

from tickertone.llm import mixing

TARGETS = mixing.Targets(
    languages=("en", "de"), patterns={"legal": "licen[sc]e", "code": "[{}]"}, language_shares={"en": 0.5, "de": 0.3}, topic_shares={"legal": 0.2}, flatten=0.5, max_passes=400, tolerance=1e-10
)


def corpus():
    rows = []
    for i in range(900):
        text = " ".join(["word"] * (3 + i % 7)) + (" licence" if i % 5 == 0 else " {x}" if i % 7 == 0 else "")
        rows.append((i, text, ("en", "en", "de", "fr", None)[i % 5 if i % 3 else 0], "hot" if i % 2 else f"s{i % 11}"))
    return [*rows, (900, None, "en", "hot"), (901, "", "de", None), (902, "a b", "en", None), (5, rows[5][1], "en", "hot"), (None, "null id", "en", "hot")]


def cell(row):
    text = row[1] or ""
    topic = "legal" if "licence" in text or "license" in text else "code" if "{" in text else "other"
    return row[3] or "", row[2] if row[2] in ("en", "de") else "other", topic, len(text.split())


def raked(cells):
    """Plain raking of a full table."""
    sides = [sorted({c[s] for c in cells}) for s in range(3)]
    sums = [{x: sum(n for c, n in cells.items() if c[s] == x) for x in sides[s]} for s in range(3)]
    shares = [{}, {"en": 0.5, "de": 0.3}, {"legal": 0.2}]
    goals = []
    for s in range(3):
        rest = 1 - sum(shares[s].values())
        free = {x: n**0.5 for x, n in sums[s].items() if x not in shares[s]}
        goals.append({x: shares[s].get(x, free.get(x, 0) * rest / sum(free.values())) for x in sides[s]})
    weights = dict.fromkeys(cells, 1.0)
    for _ in range(3000):
        for s in range(3):
            now = {x: sum(n * weights[c] for c, n in cells.items() if c[s] == x) for x in sides[s]}
            weights = {c: w * goals[s][c[s]] / now[c[s]] for c, w in weights.items()}
    return weights


def test_weights_against_plain_raking(docs):
    rows = corpus()
    cells = {}
    for row in rows:
        *key, n = cell(row)
        if n:
            cells[tuple(key)] = cells.get(tuple(key), 0) + n
    weights = raked(cells)
    most = max(weights.values())
    found = mixing.with_sampling(docs(rows), TARGETS).collect()
    assert len(found) == len(rows)
    for r in found:
        *key, n = cell((r.doc_id, r.text, r.lang, r.source))
        assert r.n_tokens == n
        if tuple(key) in weights:
            assert r.weight == pytest.approx(weights[tuple(key)], rel=1e-6)
            assert r.probability == pytest.approx(weights[tuple(key)] / most, rel=1e-6)


def test_sample_follows_the_probabilities(docs):
    table = docs(corpus())
    scored = mixing.with_sampling(table, TARGETS)
    hits = [r.n for seed in range(8) for r in mixing.with_sampling(table, TARGETS, seed).where("sampled").agg(F.count("*").alias("n")).collect()]
    expected = scored.agg(F.sum("probability")).first()[0]
    assert sum(hits) / len(hits) == pytest.approx(expected, rel=0.1)
    first = {(r.doc_id, r.text): r.sampled for r in scored.collect()}
    again = {(r.doc_id, r.text): r.sampled for r in mixing.with_sampling(table.repartition(7), TARGETS).collect()}
    assert first == again
    stayed = mixing.mixed_sample(table, TARGETS)
    assert stayed.columns == table.columns and stayed.count() == sum(r.sampled for r in scored.collect())


def test_no_documents_or_no_words(docs):
    assert mixing.with_sampling(docs([])).collect() == []
    assert [(r.weight, r.probability, r.sampled) for r in mixing.with_sampling(docs([None, ""])).collect()] == [(0.0, 0.0, False)] * 2


def monolingual(mixed=0):
    """Skewed sources of one language each (mixed of them have a little of another), with topics."""
    rows = []
    for s in range(60):
        own = "en" if s % 4 else ("de", "fr", "es")[s // 4 % 3]
        for t, mark in enumerate(("", " licence", " {x}")):
            rows.append((len(rows), "word " * (4000 // (s + 1) + 7 * (s * (t + 1) % 11) + 1) + mark, own, f"s{s}"))
        if s < mixed:
            rows.append((len(rows), "word " * 3, "de" if own == "en" else "en", f"s{s}"))
    return rows


def shares(rows, side):
    out = {}
    for r in rows:
        out[r[side]] = out.get(r[side], 0) + r.n_tokens * r.weight
    return out


@pytest.mark.parametrize("mixed", [0, 3])
def test_default_targets_are_met_by_sources_of_one_language(docs, mixed):
    targets = mixing.Targets()
    table = docs(monolingual(mixed))
    cells = mixing.with_cells(table, targets).groupBy("__source", "__language", "__topic").agg(F.sum("__tokens").alias("tokens"))
    fitted = mixing.fit(cells, targets)
    assert fitted.error <= targets.tolerance and fitted.passes < targets.max_passes
    found = mixing.with_sampling(table, targets).collect()
    flat = {}
    for r in cells.collect():
        for key in (("lang", r["__language"]), ("source", r["__source"])):
            flat[key] = flat.get(key, 0) + r.tokens**0.9
    for side in ("lang", "source"):
        total = sum(n for (s, _), n in flat.items() if s == side)
        for key, share in shares(found, side).items():
            assert share == pytest.approx(flat[side, key] / total, abs=1e-5)


def test_named_shares_are_met_by_sources_of_one_language(docs):
    targets = mixing.Targets(language_shares={"en": 0.5, "de": 0.3})
    found = shares(mixing.with_sampling(docs(monolingual()), targets).collect(), "lang")
    assert found["en"] == pytest.approx(0.5, abs=1e-5) and found["de"] == pytest.approx(0.3, abs=1e-5)


def test_shares_that_contradict_each_other_are_an_error(docs):
    rows = [(0, "word " * 50, "en", "a"), (1, "word " * 20 + "{x}", "de", "b")]
    with pytest.raises(ValueError, match="missed by up to"):
        mixing.with_sampling(docs(rows), mixing.Targets(language_shares={"de": 0.2}, topic_shares={"code": 0.6}))
