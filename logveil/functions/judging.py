"""Columns around a judge: requests, replies, rates and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the assessment buckets and the rate when nothing was decided.
HIGH_ABOVE, MODERATE_FROM, LOW_FROM, UNDECIDED_RATE = 0.60, 0.30, 0.10, 0.5
# Enumerations of the judge's replies.
RISKS = ("low", "medium", "high", "critical")
DISABLE_RISKS = ("low", "medium", "high")
VERDICTS = ("TP", "FP", "UNCERTAIN")
ASSESSMENTS = ("high_fp", "moderate_fp", "low_fp", "no_fp")
PATTERN_TUNINGS = ("disable", "tighten_regex", "no_action")
CONTEXTUAL_TUNINGS = ("disable", "add_allowlist", "reduce_scope", "no_action")
EVIDENCE_CHARS, EVIDENCE_MIN, EVIDENCE_MAX = 200, 2, 4


def is_json(text: Column) -> Column:
    """Whether `text` is one JSON value; names may repeat in an object, as the last one counts.

    Read inside brackets and inside braces: text that ends the one early breaks the other.
    """
    listed = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    named = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}"))))
    return (listed == 1) & (named == 1)


def json_in_text(raw: Column) -> Column:
    """The JSON inside free text: outermost braces if they parse, else the text without fences."""
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    unfenced = F.regexp_replace(raw, "```(?:json)?", "")
    bare = F.regexp_replace(unfenced, r"^\s+|\s*`*\s*$", "")
    return F.coalesce(
        F.when(is_json(braces), braces),
        F.when(is_json(bare), bare),
    )


def request_text(template: str, payload: Column, **fields: Column) -> Column:
    """A template with `{payload}` and other `{name}` marks filled in."""
    text = F.lit(template)
    for name, value in {**fields, "payload": F.to_json(payload)}.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return text


def rate_from_tally(false_positives: Column, true_positives: Column) -> Column:
    """Share of false positives among the decided verdicts; one half when none is decided."""
    return F.coalesce(
        F.try_divide(false_positives, false_positives + true_positives), F.lit(UNDECIDED_RATE)
    )


def assessment(rate: Column) -> Column:
    return (
        F.when(rate > HIGH_ABOVE, F.lit("high_fp"))
        .when(rate >= MODERATE_FROM, F.lit("moderate_fp"))
        .when(rate >= LOW_FROM, F.lit("low_fp"))
        .otherwise(F.lit("no_fp"))
    )


def extrapolated_fp(rate: Column, total: Column) -> Column:
    """Rate carried over to all detections, halves to the even number."""
    return F.bround(F.coalesce(rate, F.lit(0.0)) * total, 0).cast("bigint")


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition is true."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    )


def category_violations() -> Column:
    """Rules a category result breaks; reads the columns of a category verdict."""
    kind, tuning = F.col("dominant_detection_type"), F.col("tuning_recommendation")
    return _broken(
        {
            "pattern_tuning": (kind == "pattern") & ~tuning.isin(*PATTERN_TUNINGS),
            "contextual_tuning": (kind == "contextual") & ~tuning.isin(*CONTEXTUAL_TUNINGS),
            "assessment_matches_rate": F.col("overall_assessment")
            != assessment(F.col("estimated_fp_rate")),
            "assessment_known": ~F.col("overall_assessment").isin(*ASSESSMENTS),
            "disable_risk_known": ~F.col("risk_of_disabling").isin(*DISABLE_RISKS),
            "verdicts_known": F.exists(
                "per_example_verdicts", lambda v: ~v["verdict"].isin(*VERDICTS)
            ),
        }
    )


def cluster_violations() -> Column:
    """Rules a cluster result breaks; also reads `representative_messages`."""
    sensitive = F.coalesce(F.col("is_sensitive"), F.lit(False))
    evidence = F.coalesce("evidence_messages", F.array().cast("array<string>"))
    blank = [
        "intent_name",
        "detected_intent_category",
        "intent_description",
        "suggested_dlp_model",
        "suggested_model_rationale",
        "risk_level",
        "risk_rationale",
    ]
    filled = F.size(evidence) > 0
    for name in blank:
        filled = filled | F.col(name).isNotNull()
    return _broken(
        {
            "evidence_count": sensitive
            & ((F.size(evidence) < EVIDENCE_MIN) | (F.size(evidence) > EVIDENCE_MAX)),
            "evidence_length": F.exists(evidence, lambda e: F.length(e) > EVIDENCE_CHARS),
            "evidence_verbatim": F.exists(
                evidence,
                lambda e: ~F.exists("representative_messages", lambda m: F.contains(m, e)),
            ),
            "enough_counters": F.size("example_counter_phrases")
            < F.size("example_triggering_phrases"),
            "risk_known": ~F.col("risk_level").isin(*RISKS),
            "insensitive_is_blank": ~sensitive & filled,
        }
    )
