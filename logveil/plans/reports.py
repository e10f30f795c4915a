"""Report tables of the two analyses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.functions.text import percent
from logveil.operators.detections import existing_detections
from logveil.operators.filters import (
    is_detected,
    is_valid,
    needs_action,
    sensitive_only,
    with_tenant,
)
from logveil.operators.ranks import assessment_ordinal



@dataclass(frozen=True)
class IntentReport:
    summary: DataFrame
    existing: DataFrame
    suggestions: DataFrame
    results: DataFrame


@dataclass(frozen=True)
class FalsePositiveReport:
    summary: DataFrame
    actions: DataFrame
    results: DataFrame


def message_counts(records: DataFrame) -> DataFrame:
    """Messages per tenant with and without a detection, and the rows left out of all totals."""
    flagged = with_tenant(records).select(
        "tenant_id", is_valid().alias("valid"), is_detected().alias("found")
    )
    return flagged.groupBy("tenant_id").agg(
        F.count_if("valid").alias("total_messages"),
        F.count_if(F.col("valid") & F.col("found")).alias("messages_with_existing_detection"),
        F.count_if(F.col("valid") & ~F.col("found")).alias("messages_without_detection"),
        F.count_if(~F.col("valid")).alias("invalid_messages"),
    )


def funnel(records: DataFrame, cleaned: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """How many messages get how far, per tenant."""
    kept = cleaned.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("clustered_messages"))
    out = message_counts(records).join(kept, "tenant_id", "left")
    clustered = F.coalesce("clustered_messages", F.lit(0).cast("bigint"))
    out = out.withColumn("clustered_messages", clustered).withColumn(
        "dropped_in_preprocessing", F.col("messages_without_detection") - clustered
    )
    if results is None:
        return out
    judged = results.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("clusters_analyzed"),
        F.count_if("is_sensitive").alias("sensitive_clusters_found"),
    )
    return out.join(judged, "tenant_id", "left").fillna(
        0, ["clusters_analyzed", "sensitive_clusters_found"]
    )


def detection_rate(counts: DataFrame) -> DataFrame:
    return counts.withColumn(
        "detection_rate",
        percent(F.col("messages_with_existing_detection"), F.col("total_messages")),
    )


def sensitive_rate(results: DataFrame) -> DataFrame:
    """Judged clusters and how many of them are sensitive, per tenant; failures do not count."""
    return results.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("clusters_analyzed"),
        F.count_if("is_sensitive").alias("sensitive_clusters_found"),
        F.coalesce(
            F.try_divide(F.count_if("is_sensitive"), F.count(F.lit(1))), F.lit(0.0)
        ).alias("sensitive_rate"),
    )


def suggestions(results: DataFrame, keywords_shown: int = 6) -> DataFrame:
    """Sensitive clusters ranked by confidence, then size, then cluster order."""
    order = Window.partitionBy("tenant_id").orderBy(
        F.desc(F.coalesce("sensitivity_confidence", F.lit(0.0))),
        F.desc("message_count"),
        "label",
    )
    return sensitive_only(results).select(
        "tenant_id",
        F.row_number().over(order).alias("rank"),
        "cluster_id",
        "intent_name",
        "risk_level",
        "risk_rationale",
        F.col("sensitivity_confidence").alias("confidence"),
        "confidence_rationale",
        F.col("detected_intent_category").alias("intent_category"),
        "intent_description",
        "suggested_dlp_model",
        F.col("suggested_model_rationale").alias("rationale"),
        "evidence_messages",
        F.col("example_triggering_phrases").alias("example_triggers"),
        F.col("example_counter_phrases").alias("example_counters"),
        F.col("message_count").alias("message_count_in_cluster"),
        F.slice("top_keywords", 1, keywords_shown).alias("top_keywords"),
        "date_range",
    )


def ranked_categories(results: DataFrame) -> DataFrame:
    """All judged categories in report order, with their place per tenant.

    A tenant has as many rows as it has detector categories, so one window per tenant is small.
    """
    order = Window.partitionBy("tenant_id").orderBy(
        assessment_ordinal(F.col("overall_assessment")),
        F.desc(F.coalesce("estimated_fp_rate", F.lit(0.0))),
        F.desc("mean_prior"),
        "first_seq",
        "first_pos",
    )
    return results.withColumn("rank", F.row_number().over(order))


# (report column, result column)
ACTION_COLUMNS = [
    ("tenant_id", "tenant_id"),
    ("rank", "rank"),
    ("category", "category"),
    ("detection_type", "dominant_detection_type"),
    ("assessment", "overall_assessment"),
    ("assessment_rationale", "assessment_rationale"),
    ("estimated_fp_rate", "estimated_fp_rate"),
    ("fp_rate_confidence", "fp_rate_confidence"),
    ("fp_rate_rationale", "fp_rate_rationale"),
    ("total_detections", "total_detections_in_period"),
    ("estimated_tp_total", "estimated_tp_count_total"),
    ("estimated_fp_total", "estimated_fp_count_total"),
    ("sample_tp_count", "estimated_tp_count_in_sample"),
    ("sample_fp_count", "estimated_fp_count_in_sample"),
    ("fp_pattern_summary", "fp_pattern_summary"),
    ("key_fp_evidence", "key_fp_evidence"),
    ("tuning_recommendation", "tuning_recommendation"),
    ("tuning_rationale", "tuning_rationale"),
    ("suggested_allowlist", "suggested_allowlist_patterns"),
    ("risk_of_disabling", "risk_of_disabling"),
    ("mean_heuristic_fp_prior", "mean_heuristic_fp_prior"),
]


def actions(results: DataFrame) -> DataFrame:
    """Categories that need tuning, ranked; columns a judge did not give are left out."""
    ranked = ranked_categories(results).where(needs_action(F.col("overall_assessment")))
    return ranked.select(
        *[F.col(src).alias(name) for name, src in ACTION_COLUMNS if src in ranked.columns]
    )


def fp_summary(records: DataFrame, results: DataFrame) -> DataFrame:
    judged = results.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("categories_analyzed"),
        F.count_if(F.col("overall_assessment") == "high_fp").alias("high_fp_categories"),
        F.count_if(F.col("overall_assessment") == "moderate_fp").alias("moderate_fp_categories"),
    )
    return (
        message_counts(records)
        .withColumnRenamed("messages_with_existing_detection", "messages_with_detection")
        .join(judged, "tenant_id", "left")
        .fillna(0, ["categories_analyzed", "high_fp_categories", "moderate_fp_categories"])
    )


def intent_report(records: DataFrame, valid: DataFrame, cleaned: DataFrame, results: DataFrame) -> IntentReport:
    return IntentReport(
        funnel(records, cleaned, results), existing_detections(valid), suggestions(results), results
    )


def fp_report(records: DataFrame, results: DataFrame) -> FalsePositiveReport:
    return FalsePositiveReport(fp_summary(records, results), actions(results), results)
