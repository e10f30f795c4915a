"""Report, payload and audit sinks, and reading reports back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stamped(folder: str, name: str, at: datetime) -> str:
    return f"{folder.rstrip('/')}/{name}_{at:%Y%m%d_%H%M%S}"


def report_documents(
    summary: DataFrame, children: dict[str, DataFrame], generated_at: datetime
) -> DataFrame:
    """One nested JSON document per tenant: its summary and its ranked child lists."""
    stats = [c for c in summary.columns if c != "tenant_id"]
    out = summary.select("tenant_id", F.struct(*stats).alias("summary"))
    for name, rows in children.items():
        fields = [c for c in rows.columns if c != "tenant_id"]
        first = "rank" if "rank" in fields else fields[0]
        ordered = [first] + [c for c in fields if c != first]
        lists = rows.groupBy("tenant_id").agg(
            F.array_sort(
                F.collect_list(F.struct(*ordered)),
                lambda a, b: F.when(a[first] < b[first], -1).when(a[first] > b[first], 1).otherwise(0),
            ).alias(name)
        )
        out = out.join(lists, "tenant_id", "left")
    stamp = F.lit(generated_at.strftime("%Y-%m-%dT%H:%M:%SZ"))
    names = list(children)
    return out.select(
        "tenant_id",
        F.to_json(
            F.struct("tenant_id", stamp.alias("generated_at"), "summary", *names)
        ).alias("document"),
    )


def write_report(
    summary: DataFrame,
    children: dict[str, DataFrame],
    folder: str,
    name: str,
    at: datetime,
) -> str:
    """Write the documents as JSON text and the tables as Parquet; returns the folder."""
    path = stamped(folder, name, at)
    report_documents(summary, children, at).select(F.col("document").alias("value")).write.text(
        f"{path}/documents"
    )
    summary.write.parquet(f"{path}/summary")
    for child, rows in children.items():
        rows.write.parquet(f"{path}/{child}")
    return path


def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Report documents written earlier, or by another program with the same layout."""
    documents = f"{path}/documents"
    return spark.read.schema(schema).json(documents) if schema else spark.read.json(documents)


def report_rows(report: DataFrame, child: str) -> DataFrame:
    """The rows of one list of a report read back."""
    return report.select("tenant_id", F.inline(child))


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Payloads as JSON, for runs without a judge."""
    payloads.write.json(path)


# ----------------------------------------------------------------- audit events


def audit_event(rows: DataFrame, event: str, at: datetime) -> DataFrame:
    """Rows as audit events of one kind; `ts` is the run's time."""
    return rows.select(
        F.lit(at.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("ts"), F.lit(event).alias("event"), "*"
    )


def cluster_built(payloads: DataFrame, at: datetime) -> DataFrame:
    return audit_event(
        payloads.select(
            "tenant_id",
            "cluster_id",
            "message_count",
            F.col("top_keywords").alias("keywords"),
            F.col("representative_messages").alias("representatives"),
        ),
        "cluster_built",
        at,
    )


def cluster_summary(summary: DataFrame, sizes: DataFrame, algorithm: str, at: datetime) -> DataFrame:
    """How many messages each label has, as a list, besides the figures of the clustering."""
    counts = sizes.groupBy("tenant_id").agg(
        F.sort_array(F.collect_list(F.struct("label", "message_count"))).alias("label_counts")
    )
    full = summary.join(counts, "tenant_id").withColumn("algorithm", F.lit(algorithm))
    return audit_event(full, "cluster_summary", at)


def fp_category(payloads: DataFrame, at: datetime) -> DataFrame:
    return audit_event(
        payloads.select(
            "tenant_id",
            F.col("detection_category").alias("category"),
            F.col("dominant_detection_type").alias("dominant_type"),
            "total_detections",
            "samples_shown",
            F.col("mean_heuristic_fp_prior").alias("mean_fp_prior"),
            F.to_json("examples").alias("payload"),
        ),
        "fp_category",
        at,
    )


def judge_calls(attempts: DataFrame, requests: DataFrame, keys: list[str], context: str, at: datetime) -> DataFrame:
    """Each call with what was asked, what came back and what was read out of it."""
    return audit_event(
        attempts.join(requests.select(*keys, "request"), keys)
        .withColumn("context", F.lit(context))
        .withColumn("parsed_ok", F.col("outcome") == "ok"),
        "llm_call",
        at,
    )


def run_started(counts: DataFrame, mode: str, limit: int | None, at: datetime) -> DataFrame:
    """One row per tenant: what the analysis has to work on, and the most it will judge."""
    return audit_event(
        counts.select(
            "tenant_id",
            F.lit(mode).alias("mode"),
            F.col("total_messages").alias("total_records"),
            F.col("messages_with_existing_detection").alias("detected_count"),
            F.lit(limit).cast("int").alias("max_judged"),
        ),
        "run_start",
        at,
    )


def run_ended(outcomes: DataFrame, mode: str, at: datetime) -> DataFrame:
    """One row per tenant of (tenant_id, status, and figures of how far the analysis came)."""
    return audit_event(outcomes.withColumn("mode", F.lit(mode)), "run_end", at)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").partitionBy("event").json(path)
