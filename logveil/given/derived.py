"""Inputs of the later stages, derived from the given tables: judged clusters, runs, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.functions.text import normalize_space
from logveil.given.records import landed_log, minute_stamp, table, verdicts
from logveil.operators.detections import scored_detections
from logveil.operators.filters import valid_records
from logveil.operators.judge import stored_category_results
from logveil.operators.payloads import category_payloads, sampled_examples
from logveil.scratch import spread

EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string"


def valid_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_records(landed_log(spark, sf_dir))


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one tenant, clustered by source, with normalized text."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.lit("all").alias("tenant_id"),
        F.col("doc_id").alias("seq"),
        F.substring("source", 4, 10).cast("int").alias("label"),
        normalize_space(F.col("text")).alias("clean_text"),
        F.when(F.col("doc_id") % 10 == 3, F.lit(""))
        .otherwise(
            minute_stamp(F.col("doc_id"))
        )
        .alias("created_at"),
    )


def embedded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.lit("all").alias("tenant_id"),
        F.col("vec_id").alias("seq"),
        F.col("embedding").alias("vec"),
        "label",
    )


def judged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster results per (language, source); what the judge says follows from `labels`."""
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    text = normalize_space(F.col("text"))
    grouped = docs.groupBy(
        F.col("lang").alias("tenant_id"), F.substring("source", 4, 10).cast("int").alias("label")
    ).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.sum("quality").alias("good"),
        F.count("quality").alias("judged"),
        F.min_by(text, "doc_id").alias("first_text"),
        F.max_by(text, "doc_id").alias("last_text"),
        F.min(minute_stamp(F.col("doc_id"))).alias("date_from"),
        F.max(minute_stamp(F.col("doc_id"))).alias("date_to"),
    )
    confidence = F.round(1 - F.try_divide("good", "judged"), 3)
    name = F.concat(F.lit("source "), F.col("label").cast("string"))
    c = F.col("sensitivity_confidence")
    sensitive = F.col("is_sensitive")
    return (
        grouped.withColumn("sensitivity_confidence", confidence)
        .withColumn("is_sensitive", F.coalesce(c >= 0.3, F.lit(False)))
        .select(
            "tenant_id",
            "label",
            F.col("label").cast("string").alias("cluster_id"),
            "message_count",
            "is_sensitive",
            "sensitivity_confidence",
            F.lit("share of poor labels").alias("confidence_rationale"),
            F.when(sensitive, name).alias("intent_name"),
            F.when(sensitive, F.concat(F.lit("prose "), F.col("tenant_id"))).alias(
                "detected_intent_category"
            ),
            F.lit(None).cast("string").alias("intent_description"),
            F.when(sensitive, F.concat(name, F.lit(" detector"))).alias("suggested_dlp_model"),
            F.lit(None).cast("string").alias("suggested_model_rationale"),
            F.array(F.left("first_text", F.lit(150)), F.left("last_text", F.lit(250))).alias(
                "evidence_messages"
            ),
            F.array(F.lit("a"), F.lit("b")).alias("example_triggering_phrases"),
            F.when(F.col("label") % 3 == 0, F.array(F.lit("c")))
            .otherwise(F.array(F.lit("c"), F.lit("d")))
            .alias("example_counter_phrases"),
            F.when(~sensitive, F.lit(None))
            .when(c >= 0.8, F.lit("critical"))
            .when(c >= 0.6, F.lit("high"))
            .when(c >= 0.45, F.lit("medium"))
            .otherwise(F.lit("low"))
            .alias("risk_level"),
            F.lit(None).cast("string").alias("risk_rationale"),
            F.array(
                F.col("tenant_id"),
                name,
                F.lit("k3"),
                F.lit("k4"),
                F.lit("k5"),
                F.lit("k6"),
                F.lit("k7"),
            ).alias("top_keywords"),
            F.struct(F.col("date_from").alias("from"), F.col("date_to").alias("to")).alias(
                "date_range"
            ),
            F.array("first_text", F.left("last_text", F.lit(240))).alias(
                "representative_messages"
            ),
        )
    )


def judged_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category results of the derived log under the stored verdicts."""
    valid = valid_log(spark, sf_dir)
    scored = scored_detections(valid)
    examples = sampled_examples(valid, scored).drop("example")
    return stored_category_results(category_payloads(valid), examples, verdicts(spark, sf_dir))


def with_examples(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    """Results with a verdict per sampled example, as a judge lists them: the start of its text and the stored verdict."""
    valid = valid_log(spark, sf_dir)
    examples = sampled_examples(valid, scored_detections(valid)).select("tenant_id", "category", "sample_rank", "seq")
    texts = valid.select("tenant_id", "seq", F.left("input_text", F.lit(130)).alias("text"))
    listed = (
        examples.join(texts, ["tenant_id", "seq"])
        .join(verdicts(spark, sf_dir), "seq", "left")
        .groupBy("tenant_id", "category")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("sample_rank", "text", "verdict"))),
                lambda e: F.struct(
                    e["text"].alias("input_snippet"),
                    F.lit(None).cast("string").alias("flagged_entity"),
                    e["sample_rank"].cast("string").alias("entity_subcategory"),
                    e["verdict"].alias("verdict"),
                    F.lit("").alias("reason"),
                ),
            ).alias("per_example_verdicts")
        )
    )
    return results.drop("per_example_verdicts").join(listed, ["tenant_id", "category"])


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` read as runs: one mode per user, errors as failed runs, windows of 72 hours."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"),
        F.expr("cast(ts as timestamp) - interval 72 hours").alias("start_ts"),
        F.col("ts").cast("timestamp").alias("end_ts"),
        F.col("ts").cast("timestamp").alias("finished_ts"),
        F.col("user_id").cast("string").alias("mode"),
        F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("ok")).alias(
            "status"
        ),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a payload holding it twice, under changing envelope names or bare."""
    one = F.to_json(F.struct("event_id", "user_id", "event_type"))
    both = F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))
    kind = F.col("event_id") % 5
    named = lambda name: F.concat(F.lit('{"' + name + '":'), both, F.lit("}"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("payload_id"),
        F.when(kind == 0, named("logs"))
        .when(kind == 1, named("records"))
        .when(kind == 2, F.concat(F.lit('{"results":[],"data":'), both, F.lit("}")))
        .when(kind == 3, F.concat(F.lit('{"total":2,"results":'), both, F.lit("}")))
        .otherwise(both)
        .alias("payload"),
    )


def wrapped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of each event inside text, as a judge might reply."""
    kind, props = F.col("event_id") % 5, F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == 0, F.concat(F.lit("ok "), props, F.lit(" bye")))
        .when(kind == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == 2, F.lit("none"))
        .when(kind == 3, F.concat(F.lit('{"a":'), F.col("event_type")))
        .otherwise(F.concat(F.lit("```\n["), props, F.lit("]\n```")))
        .alias("raw"),
    )


