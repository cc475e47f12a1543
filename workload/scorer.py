"""A deterministic stand-in for a paid model, written so that SQL can say the same."""

from __future__ import annotations

from tickertone.plans.scorers import label_of
from tickertone.schemas import PRIMARY_MODEL


def fixture_score(text: str) -> int:
    return (len(text) * 37 + text.count("e") * 53) % 201 - 100


def fixture_scorer(headlines, region=None):
    scores = [fixture_score(text) for text in headlines]
    return [{"score": s, "sentiment": label_of(s), "sentiment_model": PRIMARY_MODEL} for s in scores]
