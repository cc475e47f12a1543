"""The registered queries over the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertone.llm import bpe, decontamination, extraction, linededup, mixing, neardup, quality, spelling, substring, topk, toxicity, vectorcodes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps when repeated windows of 35 words go."""
    found = substring.without_repeats(_table(spark, sf_dir, "documents"), digests=True)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    scores = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.withColumnRenamed("id", "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of each document."""
    verdicts = quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return verdicts.select(F.col("id").alias("doc_id"), *[F.col("measures")[c].alias(c) for c in counts], "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked token weight, probability and choice of each document."""
    sampled = mixing.with_sampling(_table(spark, sf_dir, "documents"))
    return sampled.select("doc_id", "source", "lang", "n_tokens", "weight", "probability", "sampled")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read back from the normalised archives of all pages."""
    records = warc.read_archives(warc.archive_pages(spark, _table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of the ids and of the decoded text of each document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for each fiftieth one."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that many sources show."""
    return linededup.without_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return extraction.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that phrases of the benchmark cover."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and error of each vector."""
    return vectorcodes.compressed(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of each word of the documents."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}
