"""Written intermediate tables: the way this library cuts lineage.

Iterative operators write each round to the folder named by `spark.checkpoint.dir` and read
it back. The files outlive executors, and since their size is known the planner broadcasts
them in later joins only when they are under `spark.sql.autoBroadcastJoinThreshold`.
Operators marked `only_result` remove what they wrote on the way once their result is written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_passing: ContextVar[str | None] = ContextVar("passing", default=None)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="logveil-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _new_folder(spark: SparkSession) -> str:
    return f"{_passing.get() or shared_folder(spark) + '/logveil'}/{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write `df` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = f"{_new_folder(spark)}/{label}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only_result(label: str, compression: str = "snappy") -> Callable:
    """For a function of DataFrames that returns one: write its result, then remove the tables staged inside it."""

    def mark(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(work)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            folder = _new_folder(df.sparkSession)
            outside = _passing.set(folder)
            try:
                try:
                    found = work(df, *args, **options)
                finally:
                    _passing.reset(outside)
                return stage(found, label, compression)
            finally:
                _remove(df.sparkSession, folder)

        return run

    return mark


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input that comes in fewer pieces; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
