"""JSON report of a scored batch, without a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickertone.plans.scorers import Scorer
from tickertone.plans.scoring import score_articles
from tickertone.schemas import ANALYSIS

REPORT_FIELDS = ("title", "text", "region", *ANALYSIS.names)


def batch_report(articles: DataFrame, scorer: Scorer, **options) -> DataFrame:
    """One JSON document per scored article, in arrival number ``seq``.

    Absent columns are left out and null ones written, so records keep the shape they came in.
    """
    scored = score_articles(articles, scorer, **options)
    fields = [name for name in REPORT_FIELDS if name in scored.columns]
    return scored.select("seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON lines, one file per task."""
    report.select("value").write.mode("overwrite").text(path)
