"""The scoring job: blank titles aside, headlines batched per region, scored, merged back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tickertone.functions.sentiment import headline, language
from tickertone.operators.batching import BLOCK_BITS, assign_batches, form_requests, pending_headlines
from tickertone.operators.dedup import TITLE_KEY, keyed_new, sent_near, with_title_key
from tickertone.plans.requests import build_requests
from tickertone.plans.scorers import Providers, Scorer, ask_providers
from tickertone.schemas import HEADLINES_PER_REQUEST, NO_HEADLINE_MODEL, UNSCORED
from tickertone.sources.ledger import ResponseLedger

_SCORE_FIELDS = [("score", pa.int32()), ("label", pa.string()), ("model", pa.string())]
_KEY_TYPES = {"seq": ("bigint", pa.int64()), "title": ("string", pa.string())}


def _layout(key: str) -> tuple[str, pa.Schema]:
    sql, arrow = _KEY_TYPES[key]
    return f"{key} {sql}, score int, label string, model string", pa.schema([(key, arrow), *_SCORE_FIELDS])


def run_scorer(
    requests: DataFrame,
    scorer: Scorer | Providers,
    key: str = "seq",
    ledger: ResponseLedger | None = None,
    batch: str = "",
    tasks: int = 1,
    near: str | None = None,
) -> DataFrame:
    """Call the scorer once per request row; one output row per headline.

    Only headlines, their keys and the region cross to Python, one Arrow batch at a time;
    ``Providers`` get the request bodies as well. With a ledger, requests that an earlier try of
    ``batch`` has paid for are not asked again, and ``tasks`` may run at once. ``near`` comes back
    beside the key.
    """
    layout, arrow_layout = _layout(key)
    keys, nears = f"{key}s", [f"{near}s"] if near else []
    if near:
        kind = requests.schema[f"{near}s"].dataType.elementType
        layout, arrow_layout = f"{layout}, {near} {kind.simpleString()}", arrow_layout.append(pa.field(near, to_arrow_type(kind)))
    content = ["region_key", "headlines"]
    if isinstance(scorer, Providers):
        requests = build_requests(requests)
        content += ["primary_payload", "fallback_payload", "credential_suffix"]
        score = ask_providers(scorer)
    else:

        def score(request: dict) -> list[dict]:
            return scorer(request["headlines"], request["region_key"] or None)

    def ask(request: dict) -> list[dict]:
        found = score(request)
        if len(found) != len(request["headlines"]):
            raise RuntimeError(f"scorer gave {len(found)} results for {len(request['headlines'])} headlines")
        return found

    if ledger:
        answered = ledger.ask(requests.select(keys, *nears, *content), ask, content, batch, tasks)
        lists = [F.col(keys).alias("key"), F.col("results").alias("result"), *[F.col(name).alias("near") for name in nears]]
        each = answered.select(F.explode(F.arrays_zip(*lists)).alias("e"))
        beside = [F.col("e.near").alias(near)] if near else []
        return each.select(F.col("e.key").alias(key), "e.result.score", "e.result.label", "e.result.model", *beside)

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for request in batch.to_pylist():
                found = ask(request)
                answers = [
                    {key: k, "score": r["score"], "label": r["sentiment"], "model": r["sentiment_model"]}
                    for k, r in zip(request[keys], found)
                ]
                for name in nears:
                    for answer, place in zip(answers, request[name]):
                        answer[near] = place
                rows += answers
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_layout)

    return requests.select(keys, *nears, *content).mapInArrow(score_batches, layout)


def score_requests(
    articles: DataFrame,
    scorer: Scorer | Providers,
    key: str = "seq",
    size: int = HEADLINES_PER_REQUEST,
    tasks: int | None = None,
    block_bits: int = BLOCK_BITS,
    ledger: ResponseLedger | None = None,
    batch: str = "",
    near: str | None = None,
) -> DataFrame:
    """Scores by article key. ``tasks`` sets how many requests may run at once.

    Without it there are as many tasks as the session has shuffle partitions. The number is stated,
    because requests are small and adaptive planning would fold all of them into one task.
    """
    keep = (*([key] if key != "seq" else []), *([near] if near else []))
    assigned = assign_batches(pending_headlines(articles, keep=keep), size=size, block_bits=block_bits)
    tasks = tasks or int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The grouping below reuses this partitioning, and AQE leaves its number of tasks alone.
    assigned = assigned.repartition(tasks, "region_key", "batch_no")
    return run_scorer(form_requests(assigned, key, near), scorer, key, ledger, batch, tasks, near)


def no_scores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _layout("seq")[0])


def merge_scores(articles: DataFrame, scores: DataFrame, on: str | list[str] = "seq") -> DataFrame:
    """Articles with the five analysis columns; blank titles become unscored records."""
    text = headline(F.col("title"))
    empty = text == ""

    def unless_blank(value: Column, otherwise: Column) -> Column:
        return F.when(empty, otherwise).otherwise(value)

    nothing = F.lit(None)
    return articles.join(scores, on, "left").select(
        *articles.columns,
        unless_blank(F.col("label"), F.lit(UNSCORED)).alias("sentiment"),
        unless_blank(F.col("score").cast("double"), nothing).alias("sentiment_score"),
        nothing.cast("double").alias("sentiment_confidence"),
        unless_blank(language(text), F.lit("Unknown")).alias("sentiment_language"),
        unless_blank(F.col("model"), F.lit(NO_HEADLINE_MODEL)).alias("sentiment_model"),
    )


def score_articles(articles: DataFrame, scorer: Scorer | Providers, near: str | None = None, **options) -> DataFrame:
    """Score titled articles in regional requests; every input row comes back once.

    Batching works on narrow rows (number, region, headline). The wide rows move once, for the
    join back, and not at all when the scores are small enough to broadcast or ``near`` names a
    column that the articles are spread by already: then the scores go to them.
    """
    scores = score_requests(articles, scorer, near=near, **options)
    return merge_scores(articles, sent_near(scores, near), ["seq", near]) if near else merge_scores(articles, scores)


def score_new_articles(articles: DataFrame, stored: DataFrame, scorer: Scorer | Providers, **options) -> DataFrame:
    """Dedup within the articles and against the store, then score what is new.

    Dedup comes first because Catalyst does not move a Python call past a join. New titles are
    unique, so scores come back by title: the wide rows are spread by title already and stay put.
    """
    fresh = keyed_new(articles, stored)
    scores = with_title_key(score_requests(fresh, scorer, key="title", **options)).drop("title")
    return merge_scores(fresh, scores, TITLE_KEY).drop(*TITLE_KEY)
