"""The audit trail of a run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.operators.clustering import cluster_sizes, cluster_summary
from logveil.sources import writers


@dataclass(frozen=True)
class Audit:
    """Where the events of one run go, and the time they are stamped with."""

    path: str
    at: datetime

    def _append(self, events: DataFrame) -> None:
        writers.append_audit(events, self.path)

    def run_start(self, counts: DataFrame, mode: str, limit: int | None) -> None:
        self._append(writers.run_started(counts, mode, limit, self.at))

    def run_end(self, outcomes: DataFrame, mode: str) -> None:
        self._append(writers.run_ended(outcomes, mode, self.at))

    def judge_calls(self, attempts: DataFrame, requests: DataFrame, keys: list[str], context: str) -> None:
        self._append(writers.judge_calls(attempts, requests, keys, context, self.at))

    def clusters(self, payloads: DataFrame, labels: DataFrame, algorithm: str) -> None:
        self._append(writers.cluster_built(payloads, self.at))
        self._append(writers.cluster_summary(cluster_summary(labels), cluster_sizes(labels), algorithm, self.at))

    def categories(self, payloads: DataFrame) -> None:
        self._append(writers.fp_category(payloads, self.at))


# How an analysis of one tenant can end.
OK, FAILED = "ok", "failed"
NO_UNDETECTED, TOO_FEW, NO_DETECTED = "no_undetected", "too_few_messages", "no_detected"


def intent_outcomes(counts: DataFrame, cleaned: DataFrame, results: DataFrame | None, min_samples: int) -> DataFrame:
    """Per tenant how the intent analysis ended, how many messages were left, and what was judged."""
    kept = cleaned.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("cleaned_count"))
    out = counts.select("tenant_id", "messages_without_detection").join(kept, "tenant_id", "left")
    if results is not None:
        judged = results.groupBy("tenant_id").agg(
            F.count(F.lit(1)).alias("clusters_analyzed"), F.count_if("is_sensitive").alias("sensitive_found")
        )
        out = out.join(judged, "tenant_id", "left").fillna(0, ["clusters_analyzed", "sensitive_found"])
    out = out.fillna(0, ["cleaned_count"])
    status = (
        F.when(F.col("messages_without_detection") == 0, F.lit(NO_UNDETECTED))
        .when(F.col("cleaned_count") < min_samples, F.lit(TOO_FEW))
        .otherwise(F.lit(OK))
    )
    return out.withColumn("status", status).drop("messages_without_detection")


def fp_outcomes(counts: DataFrame, results: DataFrame | None) -> DataFrame:
    """Per tenant how the false-positive analysis ended and what was judged."""
    none = F.col("messages_with_existing_detection") == 0
    out = counts.select("tenant_id", F.when(none, F.lit(NO_DETECTED)).otherwise(F.lit(OK)).alias("status"))
    if results is None:
        return out
    judged = results.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("categories_analyzed"),
        F.count_if(F.col("overall_assessment") == "high_fp").alias("high_fp"),
    )
    return out.join(judged, "tenant_id", "left").fillna(0, ["categories_analyzed", "high_fp"])


def failed(counts: DataFrame, error: str) -> DataFrame:
    return counts.select("tenant_id", F.lit(FAILED).alias("status"), F.lit(error).alias("error"))
