"""Tables and files that driver and executors share."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; in local mode without that setting, below a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, small: bool = False) -> DataFrame:
    """The rows written once to the shared folder and read from there, so that lost tasks do not repeat the work before.

    The reader knows the size in bytes, by which Spark itself decides on a broadcast. small is for
    results that are far fewer than the rows they come from: they go to as many files as the cluster
    has cores, not to one for each shuffle partition.
    """
    if small:
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    # Spark deletes the shuffle files of a finished job when the driver collects what refers to them.
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sets_aside(pattern: str) -> Callable:
    """For operators that give back the columns of their first argument: those whose names match (in any
    case) go through under other names, so that they do not clash with names inside the operator.

    Columns that the caller names in an argument stay. A table without such names is not touched.
    """
    clashing = re.compile(pattern, re.I)

    def decorate(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            named = [x for x in (*args, *kwargs.values()) if isinstance(x, str)]
            aside = {c: f"aside{i}" for i, c in enumerate(docs.columns) if clashing.fullmatch(c) and c not in named}
            if not aside:
                return operator(docs, *args, **kwargs)
            back = {new: old for old, new in aside.items()}
            out = operator(docs.toDF(*[aside.get(c, c) for c in docs.columns]), *args, **kwargs)
            return out.toDF(*[back.get(c, c) for c in out.columns])

        return run

    return decorate
