"""Tables for looking into finished reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logveil.functions.text import MISSING, decimals, display_cut, percent
from logveil.operators.filters import filter_actions, filter_suggestions
from logveil.operators.ranks import assessment_ordinal, risk_ordinal

# Fixed value: markers below this confidence are drawn at this size.
MIN_MARKER = 0.1


def shown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(MISSING))


def whole_percent(value: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(F.coalesce(value, F.lit(0.0)) * 100.0, 0))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """How often each value occurs per tenant, most frequent first; null shown as a dash."""
    return (
        rows.groupBy("tenant_id", F.coalesce(column, F.lit(MISSING)).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("tenant_id", F.desc("n"), "value")
    )


def overview(summary: DataFrame) -> DataFrame:
    """Top-line numbers per tenant from either report's summary."""
    named = [
        c
        for c in ("messages_with_existing_detection", "messages_with_detection")
        if c in summary.columns
    ]
    with_detection = F.coalesce(*named, F.lit(0))
    return summary.select(
        "tenant_id",
        "total_messages",
        with_detection.alias("detected"),
        F.col("messages_without_detection").alias("undetected"),
        percent(with_detection, F.col("total_messages")).alias("detection_rate"),
    )


def detector_ranking(existing: DataFrame) -> DataFrame:
    return existing.orderBy("tenant_id", F.desc("detections"), "name")


def suggestion_list(suggestions: DataFrame, **filters) -> DataFrame:
    """Filtered suggestions, highest risk first, in report order within a risk."""
    return filter_suggestions(suggestions, **filters).orderBy(
        "tenant_id", risk_ordinal(F.col("risk_level")), "rank"
    )


def suggestion_card(suggestions: DataFrame) -> DataFrame:
    """Short forms of dates and evidence."""
    return suggestions.select(
        "tenant_id",
        "rank",
        F.left(F.col("date_range.from"), F.lit(10)).alias("first_day"),
        F.left(F.col("date_range.to"), F.lit(10)).alias("last_day"),
        F.transform("evidence_messages", lambda e: display_cut(e, 120)).alias("evidence"),
    )


def cluster_table(results: DataFrame) -> DataFrame:
    return results.select(
        "tenant_id",
        F.col("cluster_id"),
        F.coalesce("is_sensitive", F.lit(False)).alias("sensitive"),
        F.upper(shown(F.col("risk_level"))).alias("risk_level"),
        whole_percent(F.col("sensitivity_confidence")).alias("confidence"),
        shown(F.col("intent_name")).alias("intent_name"),
        shown(F.col("detected_intent_category")).alias("category"),
        F.col("message_count").alias("messages"),
        shown(F.col("suggested_dlp_model")).alias("suggested_model"),
    )


def rate_scatter(results: DataFrame) -> DataFrame:
    return results.select(
        "tenant_id",
        F.trim(shown(F.col("category"))).alias("category"),
        F.coalesce("estimated_fp_rate", F.lit(0.0)).alias("fp_rate"),
        F.coalesce("total_detections_in_period", F.lit(0)).alias("total_detections"),
        shown(F.col("overall_assessment")).alias("assessment"),
        F.greatest(
            F.coalesce("fp_rate_confidence", F.lit(MIN_MARKER)), F.lit(MIN_MARKER)
        ).alias("confidence"),
    )


def action_list(actions: DataFrame, **filters) -> DataFrame:
    if "risk_of_disabling" not in actions.columns:
        actions = actions.withColumn("risk_of_disabling", F.lit(None).cast("string"))
    return (
        filter_actions(actions, **filters)
        .select(
            "tenant_id",
            "rank",
            F.trim(shown(F.col("category"))).alias("category"),
            "assessment",
            whole_percent(F.col("estimated_fp_rate")).alias("fp_rate"),
            whole_percent(F.col("fp_rate_confidence")).alias("fp_confidence"),
            "total_detections",
            F.col("estimated_tp_total").alias("est_tp"),
            F.col("estimated_fp_total").alias("est_fp"),
            shown(F.col("tuning_recommendation")).alias("tuning"),
            shown(F.col("detection_type")).alias("detection_type"),
            shown(F.col("risk_of_disabling")).alias("risk_of_disabling"),
        )
        .orderBy("tenant_id", "rank")
    )


def category_options(results: DataFrame) -> DataFrame:
    """Category names to choose from, the most suspicious first."""
    return results.select(
        "tenant_id",
        F.trim(shown(F.col("category"))).alias("category"),
        assessment_ordinal(F.col("overall_assessment")).alias("place"),
    ).orderBy("tenant_id", "place", "category")


def drilldown(ranked_results: DataFrame, category: str) -> DataFrame:
    """Per tenant the first result whose trimmed name is `category`."""
    first = Window.partitionBy("tenant_id").orderBy("rank")
    return (
        ranked_results.where(F.trim("category") == category)
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .drop("_n")
    )


def verdict_table(results: DataFrame) -> DataFrame:
    """The example verdicts of results that carry them, one row each, cut for display."""
    return results.select(
        "tenant_id", "category", F.posexplode("per_example_verdicts").alias("place", "v")
    ).select(
        "tenant_id",
        "category",
        "place",
        F.left(shown(F.col("v.input_snippet")), F.lit(100)).alias("snippet"),
        shown(F.col("v.flagged_entity")).alias("flagged_entity"),
        shown(F.col("v.entity_subcategory")).alias("subcategory"),
        shown(F.col("v.verdict")).alias("verdict"),
        shown(F.col("v.reason")).alias("reason"),
    )


def category_table(results: DataFrame) -> DataFrame:
    """All categories with their figures, ordered by assessment."""
    optional = {
        "fp_rate_rationale": lambda c: display_cut(c, 120),
        "assessment_rationale": lambda c: display_cut(c, 120),
        "risk_of_disabling": shown,
    }
    return results.select(
        "tenant_id",
        F.trim(shown(F.col("category"))).alias("category"),
        shown(F.col("overall_assessment")).alias("assessment"),
        whole_percent(F.col("estimated_fp_rate")).alias("fp_rate"),
        whole_percent(F.col("fp_rate_confidence")).alias("fp_confidence"),
        F.coalesce("total_detections_in_period", F.lit(0)).alias("total_detections"),
        F.coalesce("estimated_tp_count_total", F.lit(0)).alias("est_tp"),
        F.coalesce("estimated_fp_count_total", F.lit(0)).alias("est_fp"),
        F.coalesce("estimated_tp_count_in_sample", F.lit(0)).alias("sample_tp"),
        F.coalesce("estimated_fp_count_in_sample", F.lit(0)).alias("sample_fp"),
        shown(F.col("tuning_recommendation")).alias("tuning"),
        decimals(F.coalesce("mean_heuristic_fp_prior", F.lit(0.0)), 2).alias("prior"),
        shown(F.col("dominant_detection_type")).alias("detection_type"),
        assessment_ordinal(F.col("overall_assessment")).alias("place"),
        *[f(F.col(c)).alias(c) for c, f in optional.items() if c in results.columns],
    ).orderBy("tenant_id", "place", "category")
