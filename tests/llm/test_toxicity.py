import random
import zlib

import numpy as np
import pytest

from tickertone.llm import toxicity


def corpus(n=900):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abdegiklmnorstu") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["zwurst", "zPrax!", "qilf" + word()]))
        rows.append((i, " ".join(words)))
        if i % 10 < 8:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    truth = {i: int(i % 5 == 0) for i, _ in rows}
    more = [(1000, None), (1001, ""), (1002, "zwurst " * 20_000), (None, "zprax"), rows[5]]
    table = spark.createDataFrame([*labels, (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs([*rows, *more]), table).collect()
    assert len(found) == len(rows) + len(more)
    for r in found:
        assert r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, truth[r.id]) for r in found if r.held_out and r.id in truth]
    hits = sum(p and t for p, t in held)
    assert hits / sum(t for _, t in held) >= 0.95 and hits / sum(p for p, _ in held) >= 0.95
    by_id = {r.id: r.predicted for r in found}
    assert by_id[1000] == by_id[1001] == 0 and by_id[1002] == by_id[None] == 1


def test_held_out_labels_are_not_used(spark, docs):
    rows, labels = corpus(600)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    scores = []
    for x in (labels, flipped):
        scores.append({r.id: r.score for r in toxicity.toxicity_scores(docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()})
    assert scores[0] == pytest.approx(scores[1])


def test_one_class_or_nothing(spark, docs):
    table = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.toxicity_scores(docs(["a", "b"]), table).collect()] == [(0.0, 0)] * 2
    assert toxicity.toxicity_scores(docs([]), table.limit(0)).collect() == []


def test_masked_and_spelled_out_words(spark, docs):
    rows, labels = corpus()
    more = [(2000, "dem zw*rst lo"), (2001, "dem zwur5t lo"), (2002, "dem z w u r s t lo"), (2003, "dem z-w-u-r-s-t lo"), (2004, "dem a b d e lo"), (2005, "d3m l*ru!!! lo")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    by_id = {r.id: r.predicted for r in toxicity.toxicity_scores(docs([*rows, *more]), table).collect()}
    assert [by_id[2000 + i] for i in range(6)] == [1, 1, 1, 1, 0, 0]


def test_signs_of_a_text():
    signs = toxicity._Tokens().of("You utter Clown, m o r o n! l0ser *** sc*m i.d.i.o.t A.B")
    assert {"clown", "clo*", "&clown", "moron", "idiot", "loser", "sc*m", *toxicity.PATTERNS[:3]} <= signs
    assert toxicity.CAPITALS not in signs and toxicity.CAPITALS in toxicity._Tokens().of("THIS IS ALL SHOUTED")
    assert toxicity._Tokens().of(None) == toxicity._Tokens().of("") == set()


def test_one_training_row_for_each_id(spark, docs):
    table = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    rows = docs([(i % 30, f"text {i}") for i in range(600)])
    assert toxicity.training_rows(rows, table, "doc_id", "text", "toxic", 10).count() == 10


def test_given_words_vote(spark, docs):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    features = {t for t, _, _ in toxicity.chosen_tokens(spark.createDataFrame([("rare", 1, 0), ("other", 1, 0)], "token string, toxic long, clean long"), 9, 9, ("rare",))}
    assert features == {"rare"}
    found = toxicity.toxicity_scores(docs(rows), table, lexicon=("Zwurst",)).collect()
    assert all(r.predicted for r in found if "zwurst" in rows[r.id][1])


def test_label_model_without_labels_finds_the_class():
    r = np.random.default_rng(1)
    truth = r.random(6000) < 0.3
    right = (0.9, 0.8, 0.85, 0.7)
    votes = np.stack([np.where(r.random(6000) < 0.7, np.where(r.random(6000) < p, 1, -1) * np.where(truth, 1, -1), 0) for p in right], axis=1).astype(np.int8)
    model = toxicity.LabelModel.fit(votes, rounds=40)
    for j, p in enumerate(right):  # the same by counting with the true classes
        assert model.chances[j, 1, 2] == pytest.approx(0.7 * p, abs=0.06) and model.chances[j, 0, 0] == pytest.approx(0.7 * p, abs=0.06)
    prior = model.prior
    # Bayes' rule, row by row.
    for row in votes[:50]:
        odds = prior / (1 - prior)
        for j, v in enumerate(row):
            if v:
                odds *= (model.chances[j, 1, v + 1] / model.chances[j, 0, v + 1]) ** model.weights[j]
        assert model.posterior(row[None])[0] == pytest.approx(odds / (1 + odds), rel=1e-6)


def test_label_model_weighs_repeated_voters_down():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.3
    good = np.where(r.random(4000) < 0.6, np.where(truth, 1, -1) * np.where(r.random(4000) < 0.95, 1, -1), 0)
    poor = np.where(r.random(4000) < 0.6, np.where(truth, 1, -1) * np.where(r.random(4000) < 0.6, 1, -1), 0)
    votes = np.stack([good, poor, poor, poor], axis=1).astype(np.int8)
    model = toxicity.LabelModel.fit(votes, np.clip(truth, 0.2, 0.8))
    assert model.weights[0] == 1 and model.weights[1:] == pytest.approx([1 / 3] * 3, rel=0.05)
    assert model.chances[0, 1, 2] > model.chances[1, 1, 2]
