"""The table of finished runs, and what follows from it about the next one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logveil.schema import RUN_LEDGER


def append_run(
    spark: SparkSession,
    path: str,
    run_id: str,
    start: datetime,
    end: datetime,
    finished: datetime,
    mode: str,
    status: str,
) -> None:
    row = spark.createDataFrame([(run_id, start, end, finished, mode, status)], RUN_LEDGER)
    row.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; one that is missing or cannot be read counts as "never ran"."""
    try:
        ledger = spark.read.schema(RUN_LEDGER).parquet(path)
        ledger.limit(1).collect()
        return ledger
    except Exception:  # noqa: BLE001 - any unreadable state means no state
        return spark.createDataFrame([], RUN_LEDGER)


def last_success(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'ok'").agg(F.max("finished_ts").alias("last_run"))


def window_coverage(ledger: DataFrame, by: str = "mode") -> DataFrame:
    """Gap or overlap of each successful run's window with the one before it, in hours."""
    before = F.lag("end_ts").over(Window.partitionBy(by).orderBy("start_ts", "run_id"))
    apart = (F.unix_micros("start_ts") - F.unix_micros("prev_end")) / F.lit(3.6e9)
    return (
        ledger.where("status = 'ok'")
        .withColumn("prev_end", before)
        .withColumn("apart_hours", apart)
        .select(
            by,
            "run_id",
            "start_ts",
            "end_ts",
            F.greatest("apart_hours", F.lit(0.0)).alias("gap_hours"),
            F.greatest(-F.col("apart_hours"), F.lit(0.0)).alias("overlap_hours"),
            F.when(F.col("apart_hours") > 0, F.lit("gap"))
            .when(F.col("apart_hours") < 0, F.lit("overlap"))
            .otherwise(F.lit("ok"))
            .alias("coverage"),
        )
    )


def next_due(ledger: DataFrame, now: datetime, interval_hours: float = 72, by: str = "mode") -> DataFrame:
    """Seconds until the next run per mode; zero when overdue or when nothing succeeded yet."""
    seconds = F.lit(interval_hours * 3600.0) - (
        F.unix_micros(F.lit(now)) - F.unix_micros("last_run")
    ) / F.lit(1e6)
    return (
        ledger.groupBy(by)
        .agg(F.max(F.when(F.col("status") == "ok", F.col("finished_ts"))).alias("last_run"))
        .withColumn("seconds_left", F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0))))
    )
