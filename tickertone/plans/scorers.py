"""Scorers: plain callables ``(headlines, region) -> [{score, sentiment, sentiment_model}]``,
or a pair of ``Providers`` that are sent ready-made request bodies.

They run inside tasks on requests of at most five headlines; nothing here holds more than one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any, NamedTuple

from tickertone.schemas import FALLBACK_MODEL, LABELS, NEGATIVE_FROM, POSITIVE_FROM, PRIMARY_MODEL, SCORE_LIMIT

Scorer = Callable[[Sequence[str], "str | None"], list[dict[str, Any]]]
# Sends one request to a provider and gives back its generated body (text or decoded JSON).
Provider = Callable[[Sequence[str], "str | None"], Any]
# Posts one request body with the credentials of a suffix; gives back the response, text or decoded.
Send = Callable[[str, str], Any]


class Providers(NamedTuple):
    """Transports of the two providers. Payloads, envelopes and checks are not their business."""

    primary: Send
    fallback: Send
    primary_model: str = PRIMARY_MODEL
    fallback_model: str = FALLBACK_MODEL


class ResponseError(ValueError):
    """A provider answered with something that is not a full, valid set of scores."""


def label_of(score: int) -> str:
    positive, neutral, negative = LABELS
    if score >= POSITIVE_FROM:
        return positive
    return negative if score <= NEGATIVE_FROM else neutral


def read_scores(body: Any, expected: int) -> list[int]:
    """Scores in headline order, or ``ResponseError``; one bad item rejects the response."""
    try:
        payload = json.loads(body) if isinstance(body, str) else body
    except json.JSONDecodeError as error:
        raise ResponseError("response is not JSON") from error
    items = payload.get("results") if isinstance(payload, dict) else None
    if not isinstance(items, list) or len(items) != expected:
        raise ResponseError(f"response does not hold {expected} results")
    pairs = [(i.get("id"), i.get("score")) if isinstance(i, dict) else (None, None) for i in items]
    # bool is an int to isinstance, so the exact type is compared.
    if any(type(value) is not int for pair in pairs for value in pair):
        raise ResponseError("ids and scores must be whole numbers")
    by_id = dict(pairs)
    if by_id.keys() != set(range(1, expected + 1)):
        raise ResponseError("ids must be 1 to n, each once")
    if any(abs(score) > SCORE_LIMIT for score in by_id.values()):
        raise ResponseError("score out of range")
    return [by_id[i] for i in sorted(by_id)]


def labelled(scores: Sequence[int], model: str) -> list[dict[str, Any]]:
    return [{"score": s, "sentiment": label_of(s), "sentiment_model": model} for s in scores]


def provider_scorer(provider: Provider, model: str) -> Scorer:
    """Scorer that validates one provider's answers and labels them."""

    def score(headlines: Sequence[str], region: str | None = None) -> list[dict[str, Any]]:
        if not headlines:
            return []
        return labelled(read_scores(provider(headlines, region), len(headlines)), model)

    return score


def first_or_second(primary: Callable, fallback: Callable) -> Callable:
    """Ask ``fallback`` when ``primary`` fails in any way; both failing names both errors."""

    def ask(*request):
        try:
            return primary(*request)
        except Exception as first:  # any failure of the primary hands over
            try:
                return fallback(*request)
            except Exception as second:
                raise RuntimeError(f"primary scorer failed ({first}); fallback scorer failed ({second})") from second

    return ask


def with_fallback(primary: Scorer, fallback: Scorer) -> Scorer:
    ask = first_or_second(primary, fallback)

    def score(headlines: Sequence[str], region: str | None = None) -> list[dict[str, Any]]:
        return ask(headlines, region) if headlines else []

    return score


def walk(response: Any, *path: str | int) -> Any:
    """The value at a path of a response, or ``ResponseError`` when its shape is another."""
    value = json.loads(response) if isinstance(response, str) else response
    for step in path:
        try:
            value = value[step]
        except (KeyError, IndexError, TypeError) as error:
            raise ResponseError("unexpected response shape") from error
    return value


def ask_providers(providers: Providers) -> Callable[[Mapping[str, Any]], list[dict[str, Any]]]:
    """Scores of one built request row: primary provider, then the fallback."""

    def primary(request: Mapping[str, Any]) -> list[dict[str, Any]]:
        response = walk(providers.primary(request["primary_payload"], request["credential_suffix"]))
        if walk(response, "success") is not True:
            raise ResponseError("provider reports a failure")
        body = walk(response, "result", "response")
        return labelled(read_scores(body, len(request["headlines"])), providers.primary_model)

    def fallback(request: Mapping[str, Any]) -> list[dict[str, Any]]:
        response = providers.fallback(request["fallback_payload"], request["credential_suffix"])
        body = walk(response, "candidates", 0, "content", "parts", 0, "text")
        return labelled(read_scores(body, len(request["headlines"])), providers.fallback_model)

    return first_or_second(primary, fallback)


def credential(name: str, suffix: str, secrets: Mapping[str, str]) -> str:
    """The credential of a suffix, such as ``NAME_NEPALI``; missing ones are an error for ``Send`` to raise."""
    value = secrets.get(name + suffix, "").strip()
    if not value:
        raise RuntimeError(f"{name + suffix} is not set")
    return value
