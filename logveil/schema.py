"""Fixed schemas of the tables that go in and out of the jobs.

Field names are fixed values: logs, judge replies and reports are exchanged under them.
"""

from pyspark.sql import types as T

S, D, B, L, I = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DETECTION = _struct(
    id=S,
    name=S,
    code_name=S,
    type=S,
    detection_type=S,
    reason=S,
    sensitive_entities=T.ArrayType(S),
    entity_texts_with_subcategories=T.MapType(S, S),
)

# as found in a log file; `seq` and `event_ts` are added when it is read. `errors` is JSON text, but
# a string in it comes without quotes unless it spells an empty value (`"0"`), which is an error
LOG_RECORD = _struct(
    tenant_id=S,
    created_at=S,
    input_text=S,
    errors=S,
    response_jsonl=T.ArrayType(DETECTION),
)

CLUSTER_VERDICT = _struct(
    cluster_id=S,
    is_sensitive=B,
    sensitivity_confidence=D,
    confidence_rationale=S,
    intent_name=S,
    detected_intent_category=S,
    intent_description=S,
    suggested_dlp_model=S,
    suggested_model_rationale=S,
    evidence_messages=T.ArrayType(S),
    example_triggering_phrases=T.ArrayType(S),
    example_counter_phrases=T.ArrayType(S),
    risk_level=S,
    risk_rationale=S,
)

CATEGORY_VERDICT = _struct(
    detection_category=S,
    dominant_detection_type=S,
    estimated_fp_rate=D,
    fp_rate_confidence=D,
    fp_rate_rationale=S,
    estimated_tp_count_in_sample=I,
    estimated_fp_count_in_sample=I,
    fp_pattern_summary=S,
    tuning_recommendation=S,
    tuning_rationale=S,
    per_example_verdicts=T.ArrayType(
        _struct(input_snippet=S, flagged_entity=S, entity_subcategory=S, verdict=S, reason=S)
    ),
    key_fp_evidence=T.ArrayType(
        _struct(input_snippet=S, flagged_entity=S, entity_subcategory=S, verdict=S, fp_reason=S)
    ),
    suggested_allowlist_patterns=T.ArrayType(S),
    risk_of_disabling=S,
    overall_assessment=S,
    assessment_rationale=S,
)

RUN_LEDGER = _struct(
    run_id=S,
    start_ts=T.TimestampType(),
    end_ts=T.TimestampType(),
    finished_ts=T.TimestampType(),
    mode=S,
    status=S,
)

# one visible run: its attempt, the tables it wrote, and how each of its analyses ended
MANIFEST = _struct(
    run_id=S,
    attempt=S,
    tables=T.ArrayType(S),
    modes=T.ArrayType(_struct(mode=S, status=S, error=S)),
    start_ts=T.TimestampType(),
    end_ts=T.TimestampType(),
    finished_ts=T.TimestampType(),
)
