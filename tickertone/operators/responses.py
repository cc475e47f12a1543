"""Provider responses as columns: envelope, validation and mapping back to headlines.

These read stored response text. A live response goes through ``plans.scorers``, whose JSON
reading is stricter (nothing may follow the closing brace).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickertone.functions.sentiment import label
from tickertone.schemas import SCORE_LIMIT

_RESULTS = "results array<struct<id:int,score:int>>"
_STRICT = {"allowSingleQuotes": "false"}


_PRIMARY = "success boolean, result struct<response:string>"
_FALLBACK = "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"


def primary_body(response: Column) -> Column:
    """Generated JSON of a primary response, as text or as an object.

    Null unless the envelope says success with a JSON ``true`` and carries a body.
    """
    envelope = F.from_json(response, _PRIMARY)
    return F.when(envelope["success"], envelope["result"]["response"])


def fallback_body(response: Column) -> Column:
    """Text of the first part of the first candidate; null for any other shape."""
    candidate = F.get(F.from_json(response, _FALLBACK)["candidates"], F.lit(0))
    return F.get(candidate["content"]["parts"], F.lit(0))["text"]


def read_results(body: Column) -> Column:
    """``array<struct<id,score>>``; a value that is not a whole number reads as null."""
    return F.from_json(body, _RESULTS, _STRICT)["results"]


def valid_results(results: Column, size: Column) -> Column:
    """All or nothing: one whole-number score in range for every id from 1 to ``size``."""

    def sound(item: Column) -> Column:
        return (
            item.isNotNull()
            & item["id"].between(1, size)
            & item["score"].between(-SCORE_LIMIT, SCORE_LIMIT)
        )

    checked = (
        (F.size(results) == size)
        & F.forall(results, lambda item: F.coalesce(sound(item), F.lit(False)))
        & (F.size(F.array_distinct(F.transform(results, lambda item: item["id"]))) == size)
    )
    return F.coalesce(checked, F.lit(False))


def scores_in_order(results: Column) -> Column:
    """Scores of a valid response in headline order, whatever order the response had."""
    return F.transform(F.array_sort(results), lambda item: item["score"])


def map_responses(requests: DataFrame, body: str = "body") -> DataFrame:
    """One row per headline of each valid response, matched by id inside its request row.

    Requests and their responses sit in one row, so matching needs no shuffle.
    """
    results = read_results(F.col(body))
    return (
        requests.withColumn("_results", results)
        .where(valid_results(F.col("_results"), F.size("headlines")))
        .withColumn("_scores", scores_in_order(F.col("_results")))
        .select(
            "region_key",
            "batch_no",
            F.posexplode(F.arrays_zip("seqs", "headlines", "_scores")).alias("_at", "_item"),
        )
        .select(
            "region_key",
            "batch_no",
            (F.col("_at") + 1).alias("item_id"),
            F.col("_item.seqs").alias("seq"),
            F.col("_item.headlines").alias("headline"),
            F.col("_item._scores").alias("score"),
            label(F.col("_item._scores")).alias("sentiment"),
        )
    )


def resolve_fallback(
    requests: DataFrame, primary_model: str, fallback_model: str,
    primary: str = "primary_response", fallback: str = "fallback_response",
) -> DataFrame:
    """Primary body when it is valid, else the fallback's, with the model that answered.

    ``body`` and ``sentiment_model`` are null where both are invalid.
    """
    size = F.size("headlines")
    first, second = primary_body(F.col(primary)), fallback_body(F.col(fallback))
    first_ok = valid_results(read_results(F.col("_first")), size)
    second_ok = valid_results(read_results(F.col("_second")), size)
    return (
        requests.withColumns({"_first": first, "_second": second})
        .withColumns({"_first_ok": first_ok, "_second_ok": second_ok})
        .withColumn(
            "body",
            F.when(F.col("_first_ok"), F.col("_first")).when(F.col("_second_ok"), F.col("_second")),
        )
        .withColumn(
            "sentiment_model",
            F.when(F.col("_first_ok"), primary_model).when(F.col("_second_ok"), fallback_model),
        )
        .drop("_first", "_second", "_first_ok", "_second_ok")
    )
