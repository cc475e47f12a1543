"""Connected components by alternating stars, without collecting a node's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickertone.llm.shared import written


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node and root, the smallest node that it is linked with, for each node of edges (u, v).

    Each round links a node's larger neighbours, then its smaller ones, to the least of them; a
    round touches each edge a few times, and rounds grow as the logarithm of the longest chain. The
    least ones are written before they are joined back, so Spark splits the node of a very large star.
    Stops with an error if max_rounds do not suffice. Edges from a node to itself are ignored.
    """
    edges = written(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = _mirrored(edges)
        large = both.join(written(_least(both), small=True), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        large = written(large)
        least = written(large.groupBy("u").agg(F.min("v").alias("least")), small=True)
        tied = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = written(tied.unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
