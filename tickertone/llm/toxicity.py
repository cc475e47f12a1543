"""Toxicity scores by weak supervision.

Voters look at the whole text. Lexicon voters are words, word beginnings and words after a form of
address; those given by the caller vote always, others where they go with the label on training rows.
Words written with digits or marks for letters, or letter by letter, count as the words they stand for.
Pattern voters see masked words, spelled-out words, runs of marks and texts in capitals, whatever the
words. A further voter votes clean where no lexicon voter stands. A generative label model estimates by
expectation maximisation how each voter votes given the unknown class, and how far voters repeat each
other; it starts from the lexicon votes and never sees the labels. Its posteriors are the labels on
which a linear classifier over all of these signs is trained. Candidate counts are an aggregation over
all training rows of the sample; the driver holds one bounded table.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tickertone.llm.shared import written
from tickertone.llm.text import pieces

#: Labelled rows that the models are fitted on: those with the least hash of the id.
MAX_TRAINING_ROWS = 20_000
#: Tokens that the classifier sees, voters, and rows that a token must stand in.
MAX_FEATURES, MAX_VOTERS, MIN_ROWS, MIN_ERRORS = 4096, 400, 5, 2
#: Share of toxic rows among those with a token, smoothed, from which on it votes.
MIN_PRECISION = 0.9
#: Voters that a toxic row may stand for before it counts no more in the choice of others.
COVER = 3
#: Lengths of word beginnings.
PREFIXES = range(3, 7)
_WORD = regex.compile(r"\p{L}+")

# Forms of address, and the letters that digits and marks stand for.
ADDRESS = frozenset("you your youre du dein deine ihr tu ton ta vous votre eres usted tus".split())
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

#: Signs that no word has, as they hold a space; each is a voter.
MASKED, SPELLED, MARKS, CAPITALS = PATTERNS = ("masked word", "spelled-out word", "run of marks", "mostly capitals")
_INNER = regex.compile(r"(?<!\p{L})\p{L}++(?:[0-9@$!*._+-]++\p{L}++)+")
_SPELLED = regex.compile(r"(?<!\S)\p{L}(?:\s\p{L}(?![\p{L}\p{N}])){3,}+")
_NOT_LETTERS, _NOT_LETTERS_OR_STAR = regex.compile(r"[^\p{L}]+"), regex.compile(r"[^\p{L}*]+")


def is_held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def with_beginnings(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def tokens_of(run: str) -> list[str]:
    """Words of a run without white space, and their beginnings, marked by a star."""
    out = [t for word in _WORD.findall(run) for t in with_beginnings(word)]
    for masked in _INNER.findall(run):
        likely = masked.translate(LOOKALIKES)
        starred = _NOT_LETTERS_OR_STAR.sub("", likely)
        out += [MASKED, *with_beginnings(_NOT_LETTERS.sub("", likely)), *([starred] if "*" in starred else [])]
    return out


class _Tokens(dict):
    """Run to its tokens; emptied when it has grown large."""

    def of(self, text: str | None) -> set[str]:
        """All signs of a text."""
        whole = unicodedata.normalize("NFKC", text or "")
        low = whole.lower()
        runs = low.split()
        out = {t for r in set(runs) for t in self[r]}
        for i, run in enumerate(runs):
            if run in ADDRESS:
                out |= {"&" + word for r in runs[i + 1 : i + 3] for word in _WORD.findall(r)}
        if sum(len(r) == 1 for r in runs) >= 3:  # the last letter may have a mark
            spelled = {_NOT_LETTERS.sub("", x) for x in _SPELLED.findall(low)}
            if spelled:
                out |= {SPELLED, *(t for word in spelled for t in with_beginnings(word))}
        if any(3 * mark in low for mark in "!?*#$%&"):
            out.add(MARKS)
        if len(runs) >= 3 and 2 * sum(map(str.isupper, whole.split())) > len(runs):
            out.add(CAPITALS)
        return out

    def __missing__(self, run: str) -> list[str]:
        if len(self) > 200_000:
            self.clear()
        self[run] = out = tokens_of(run)
        return out


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, max_rows: int) -> DataFrame:
    """text and toxic of the labelled rows that may be learnt from, max_rows at most, taken by a hash of the id; one text for each id."""
    marks = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_column}`").isNotNull())
    marks = marks.groupBy(F.col(f"`{id_column}`").alias("id")).agg((F.max(F.col(f"`{label}`")) >= 1).alias("toxic"))
    marks = marks.where(~is_held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.join(F.broadcast(written(marks)), "id")  # max_rows ids
    return rows.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def token_counts(rows: DataFrame) -> DataFrame:
    """token, toxic and clean: rows of either kind that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for whole in batches:
            for batch in pieces(whole, "text"):
                counts = (Counter(), Counter())
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    counts[toxic].update(known.of(text))
                names = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())],
                    names=["token", "toxic", "clean"],
                )

    found = rows.mapInArrow(run, "token string, toxic long, clean long")
    return found.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def chosen_tokens(counts: DataFrame, n_toxic: int, n_clean: int, lexicon: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """The MAX_FEATURES tokens whose frequency differs most between the classes, in standard errors, MIN_ERRORS at least; and patterns and given words."""
    a, b = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.5) / (n_clean + 1)
    error = F.sqrt(a * (1 - a) / n_toxic + b * (1 - b) / n_clean)
    always = counts.where(F.col("token").isin([*PATTERNS, *lexicon]))
    counts = counts.where(F.col("toxic") + F.col("clean") >= MIN_ROWS).withColumn("errors", F.abs(a - b) / error)
    best = counts.where(F.col("errors") >= MIN_ERRORS).orderBy(F.desc("errors"), F.length("token"), "token").limit(MAX_FEATURES)
    return list(dict.fromkeys((r.token, r.toxic, r.clean) for r in [*best.collect(), *always.collect()]))


def present(rows: DataFrame, features: list[str]) -> DataFrame:
    """toxic, and found: the numbers of the features that a row holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known = {t: i for i, t in enumerate(features)}, _Tokens()
        for whole in batches:
            for batch in pieces(whole, "text"):
                found = [sorted(numbers[t] for t in known.of(x) if t in numbers) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    return rows.mapInArrow(run, "toxic boolean, found array<int>")


def voters(tokens: list[tuple[str, int, int]], found: list[np.ndarray], toxic: np.ndarray) -> list[int]:
    """Numbers of the tokens that vote toxic, patterns aside, by greedy cover.

    A token counts the toxic rows that fewer than COVER chosen voters stand in; words that merely
    come along in copies of a covered row count for nothing. Of equals the longest is taken.
    """
    share = toxic.mean()
    good = [i for i, (_, a, b) in enumerate(tokens) if (a + share) / (a + b + 1) >= MIN_PRECISION and tokens[i][0] not in PATTERNS]
    holders: dict[int, list[int]] = {i: [] for i in good}
    for row in np.flatnonzero(toxic):
        for i in found[row]:
            if i in holders:
                holders[i].append(row)
    rows = {i: np.array(x, np.int64) for i, x in holders.items()}
    need, chosen = np.full(len(found), COVER), []
    while rows and len(chosen) < MAX_VOTERS:
        gain = {i: int((need[x] > 0).sum()) - 10 * tokens[i][2] for i, x in rows.items()}
        best = max(gain, key=lambda i: (gain[i], len(tokens[i][0]), tokens[i][0]))
        if gain[best] < MIN_ROWS:
            break
        need[rows.pop(best)] -= 1
        chosen.append(best)
        rows = {i: x for i, x in rows.items() if gain[i] >= MIN_ROWS}  # gains only fall
    return chosen


@dataclass
class LabelModel:
    """Chances of each vote (clean, none, toxic) given the class, weights against repetition, and the class prior."""

    chances: np.ndarray  # voter, class, vote
    weights: np.ndarray
    prior: float

    @classmethod
    def fit(cls, votes: np.ndarray, first: np.ndarray | None = None, rounds: int = 10, tied: float = 0.5) -> LabelModel:
        """votes holds -1, 0 or 1 by row and voter; first is the starting posterior of each row, else the votes' majority.

        A voter's deviations from what the class makes expected are correlated with those of others;
        those above tied are taken as dependence, and a voter weighs
        one over its effective number of copies, 1 and the sum of their squares: many forms of one
        sign count about once. The class balance is that of the start.
        """
        posterior, model = (np.where(votes.sum(axis=1) > 0, 0.98, 0.02) if first is None else first.astype(float)), None
        shown = [(votes == v).astype(np.float32) for v in (-1, 0, 1)]
        fired = (votes != 0).astype(np.float32)
        prior = float(np.clip(posterior.mean(), 1e-4, 1 - 1e-4))
        for _ in range(rounds):
            by_class = np.stack([1 - posterior, posterior], axis=1).astype(np.float32)
            counts = np.stack([(by_class.T @ s).T for s in shown], axis=2) + 0.1
            chances = counts / counts.sum(axis=2, keepdims=True)
            rest = fired - by_class @ (1 - chances[:, :, 1]).T.astype(np.float32)
            norm = np.sqrt((rest**2).sum(axis=0)) + 1e-9
            tie = (rest / norm).T @ (rest / norm)
            np.fill_diagonal(tie, 0)
            weights = 1 / (1 + (np.where(tie > tied, tie, 0) ** 2).sum(axis=1))
            model = cls(chances, weights, prior)
            posterior = model.posterior(votes)
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        ratio = np.log(self.chances[:, 1] / self.chances[:, 0]) * self.weights[:, None]
        for k, v in ((0, -1), (2, 1)):  # no vote says nothing
            odds += (votes == v) @ ratio[:, k]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_classifier(found: list[np.ndarray], targets: np.ndarray, n_features: int, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on presence, by Adam over all rows."""
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    column = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    weights, mean, square = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, rounds + 1):
        odds = np.bincount(row, weights[column], len(found)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - targets) / len(found)
        slope = np.append(np.bincount(column, error[row], n_features), error.sum())
        slope[:-1] += penalty * weights[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights = weights - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return weights[:-1], float(weights[-1])


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]
    bias: float


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS, lexicon: tuple[str, ...] = ()
) -> Classifier | None:
    """The classifier, or None where the training rows hold one class only."""
    rows = written(training_rows(docs, labels, id_column, text, label, max_rows))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    lexicon = tuple(x.lower() for x in lexicon)
    tokens = chosen_tokens(written(token_counts(rows)), sizes[True], sizes[False], lexicon)
    features = [t for t, _, _ in tokens]
    table = present(rows, features).toArrow()  # max_rows rows of their features' numbers at most
    lists = table.column("found").combine_chunks()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    found = np.split(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends[:-1])
    words = voters(tokens, found, table.column("toxic").to_numpy().astype(float))
    words += [i for i, t in enumerate(features) if t in lexicon and i not in words]
    voting = words + [i for i, t in enumerate(features) if t in PATTERNS]
    place = np.full(len(features), -1)
    place[voting] = np.arange(len(voting))
    votes = np.zeros((len(found), len(voting) + 1), np.int8)
    for i, x in enumerate(found):
        at = place[x]
        votes[i, at[at >= 0]] = 1
    named = votes[:, : len(words)].any(axis=1)
    votes[:, -1] = np.where(named, 0, -1)
    posterior = LabelModel.fit(votes, np.where(named, 0.98, 0.02)).posterior(votes)
    weights, bias = fit_classifier(found, posterior, len(features))
    by_sign = dict(zip(features, weights.tolist(), strict=True))
    for word in (features[i] for i in words):
        if _WORD.fullmatch(word):
            # A star for one inner letter stands for the word and the beginnings that the whole word shows.
            value = math.fsum(by_sign.get(t, 0.0) for t in with_beginnings(word))
            for i in range(1, len(word) - 1):
                by_sign.setdefault(f"{word[:i]}*{word[i + 1 :]}", value)
    return Classifier(by_sign, bias)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", cutoff: float = 0.3, max_rows: int = MAX_TRAINING_ROWS,
    lexicon: tuple[str, ...] = (),
) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 from cutoff on) of each row of docs, repeated rows too.

    Labels are learnt only from rows that are not held out; the highest of several labels of an id
    counts, rows with a null id or label say nothing. Scores use the text alone. A null text scores
    as an empty one. Where the training rows lack a class, all scores are 0. Of several rows of an id
    one is learnt from. Words of lexicon vote wherever a training row holds them.
    """
    model = train(docs, labels, id_column, text, label, max_rows, lexicon)
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), is_held_out(F.col(f"`{id_column}`")).alias("held_out"), F.col(f"`{text}`").alias("text"))
    if model is None:
        return rows.select("id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = model.weights, _Tokens()
        for whole in batches:
            for batch in pieces(whole, "text"):
                odds = [model.bias + math.fsum(weights[t] for t in known.of(x) if t in weights) for x in batch.column("text").to_pylist()]
                score = 1 / (1 + np.exp(-np.clip(np.array(odds, float), -50, 50)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= cutoff).astype(np.int32))], names=["id", "held_out", "score", "predicted"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
