"""Responses already paid for, so that a batch that runs again asks only for what is missing.

A request is known by the hash of its content and of the scorer's name. The answers of a batch are
written before anything else is made from them; a request that failed is written as failed and does
not take the answers of others with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertone.sources.folders import remove

_RESULT = pa.struct([("score", pa.int32()), ("label", pa.string()), ("model", pa.string())])
_ANSWER = pa.schema([("request_id", pa.string()), ("results", pa.list_(_RESULT)), ("error", pa.string())])
_LAYOUT = "request_id string, results array<struct<score: int, label: string, model: string>>, error string"


class ResponseLedger:
    """``name`` tells scorers apart: a model, a prompt version."""

    def __init__(self, spark: SparkSession, path: str, name: str = ""):
        self.spark, self.path, self.name = spark, path, name
        spark.createDataFrame([], f"{_LAYOUT}, batch string").write.mode("ignore").partitionBy("batch").parquet(path)

    def answers(self, batch: str) -> DataFrame:
        """What is known of the requests of a batch; one folder is read."""
        known = self.spark.read.schema(f"{_LAYOUT}, batch string").parquet(self.path)
        return known.where(F.col("batch") == batch).drop("batch")

    def ask(self, requests: DataFrame, ask: Callable[[dict], list[dict]], content: list[str], batch: str, tasks: int) -> DataFrame:
        """requests with their ``results``, each asked for at most once over all tries of the batch.

        ``content`` names the columns that make a request. A task that is lost before its answers are
        written asks again; what has been written is not asked for again. Requests of equal content
        are one; ``tasks`` of them may run at once. If any failed, the others' answers are kept and the first error is raised.
        """
        known = F.sha2(F.to_json(F.struct(F.lit(self.name).alias("scorer"), *content)), 256)
        requests = requests.withColumn("request_id", known)
        paid = self.answers(batch).where("error IS NULL")
        open_ = requests.select("request_id", *content).join(paid, "request_id", "left_anti").dropDuplicates(["request_id"])
        # Stated, as requests are small and adaptive planning would ask all of them in one task.
        open_ = open_.repartition(tasks, "request_id")

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in batches:
                rows = []
                for request in some.to_pylist():
                    row = {"request_id": request["request_id"], "results": None, "error": None}
                    try:
                        found = ask(request)
                        row["results"] = [{"score": r["score"], "label": r["sentiment"], "model": r["sentiment_model"]} for r in found]
                    except Exception as error:  # kept with the others and raised once they are safe
                        row["error"] = f"{type(error).__name__}: {error}"
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=_ANSWER)

        asked = open_.mapInArrow(answer, _LAYOUT).withColumn("batch", F.lit(batch))
        asked.write.mode("append").partitionBy("batch").parquet(self.path)
        answers = self.answers(batch)
        paid = answers.where("error IS NULL").dropDuplicates(["request_id"])
        failed = answers.where("error IS NOT NULL").join(paid, "request_id", "left_anti").select("error").first()
        if failed:
            raise RuntimeError(failed.error)
        return requests.join(paid.drop("error"), "request_id").drop("request_id")

    def forget(self, batch: str) -> None:
        """Drop the answers of a batch that is stored for good."""
        remove(self.spark, f"{self.path}/batch={batch}")
