"""Row filters of the two analyses and the funnel guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logveil.functions.columns import falsy
from logveil.functions.text import matches_any, normalize_space, token_count


def is_valid() -> Column:
    """Has text and no error; written so that both tests reach the Parquet scan."""
    text = F.col("input_text")
    return text.isNotNull() & (text != "") & falsy(F.col("errors"))


def is_detected() -> Column:
    """Has detections; asks for one nested field, so that a scan need not read the others."""
    return F.coalesce(F.size("response_jsonl.name"), F.lit(0)) > 0


def with_tenant(records: DataFrame) -> DataFrame:
    return records.withColumn("tenant_id", F.coalesce(F.col("tenant_id"), F.lit("unknown")))


def valid_records(records: DataFrame) -> DataFrame:
    """Usable rows with the detected/undetected flag, from a single scan."""
    return with_tenant(records).where(is_valid()).withColumn("is_detected", is_detected())


def detected(valid: DataFrame) -> DataFrame:
    return valid.where("is_detected")


def undetected(valid: DataFrame) -> DataFrame:
    return valid.where(~F.col("is_detected"))


def long_enough(records: DataFrame, min_tokens: int = 15) -> DataFrame:
    """Messages with enough tokens, with the normalized text as `clean_text`."""
    return records.where(token_count(F.col("input_text")) >= min_tokens).withColumn(
        "clean_text", normalize_space(F.col("input_text"))
    )


def frequent_categories(profile: DataFrame, min_occurrences: int = 2) -> DataFrame:
    return profile.where(F.col("total_detections") >= min_occurrences)


def needs_action(assessment: Column) -> Column:
    return F.coalesce(assessment.isin("high_fp", "moderate_fp"), F.lit(False))


def sensitive_only(results: DataFrame) -> DataFrame:
    return results.where(F.coalesce(F.col("is_sensitive"), F.lit(False)))


def run_status(funnel: DataFrame, min_samples: int = 3) -> DataFrame:
    """Per tenant, whether each analysis can go on and why not."""
    without, kept = F.col("messages_without_detection"), F.col("clustered_messages")
    return funnel.select(
        "tenant_id",
        F.when(without == 0, F.lit("No undetected messages found"))
        .when(
            kept < min_samples,
            F.concat(
                F.lit("Only "),
                kept.cast("string"),
                F.lit(" messages after preprocessing — not enough to cluster"),
            ),
        )
        .otherwise(F.lit("ok"))
        .alias("intent_status"),
        F.when(
            F.col("messages_with_existing_detection") == 0, F.lit("No detected messages found")
        )
        .otherwise(F.lit("ok"))
        .alias("fp_status"),
    )


def filter_suggestions(
    suggestions: DataFrame,
    risks: Iterable[str] = ("critical", "high", "medium", "low"),
    min_confidence: float = 0.0,
    search: str = "",
) -> DataFrame:
    return suggestions.where(
        F.col("risk_level").isin(list(risks))
        & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence)
        & matches_any(
            search, F.col("intent_name"), F.col("intent_category"), words=F.col("top_keywords")
        )
    )


def filter_actions(
    actions: DataFrame,
    assessments: Iterable[str] = ("high_fp", "moderate_fp"),
    tunings: Iterable[str] = (),
    search: str = "",
) -> DataFrame:
    kept = actions.where(F.col("assessment").isin(list(assessments)))
    tunings = list(tunings)
    if tunings:
        kept = kept.where(F.col("tuning_recommendation").isin(tunings))
    return kept.where(matches_any(search, F.col("category")))
