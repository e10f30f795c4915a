"""Figures per look-back window for runs at a fixed cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.functions.text import percent


def detection_rate_by_window(valid: DataFrame, hours: int = 72) -> DataFrame:
    """Messages, detected messages and their share per tenant and tumbling window.

    Works on a batch as well as on a stream (give the stream a watermark on `event_ts`).
    """
    return (
        valid.groupBy("tenant_id", F.window("event_ts", f"{hours} hours").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total_messages"),
            F.count_if("is_detected").alias("detected_messages"),
        )
        .select(
            "tenant_id",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "total_messages",
            "detected_messages",
            percent(F.col("detected_messages"), F.col("total_messages")).alias("detection_rate"),
        )
    )
