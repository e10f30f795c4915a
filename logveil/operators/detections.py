"""Per-detection rows and per-category figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.config import Settings
from logveil.functions.detections import (
    category_name,
    detector_kind,
    distinct_entities,
    suspicion_score,
    total_entities,
)
from logveil.functions.text import token_count

CATEGORY = ["tenant_id", "category"]


def explode_detections(valid: DataFrame) -> DataFrame:
    """One row per detection with its position; the message text is not copied along."""
    return valid.select(
        "tenant_id",
        "seq",
        token_count(F.col("input_text")).alias("tokens"),
        F.posexplode("response_jsonl").alias("det_pos", "det"),
    )


def scored_detections(valid: DataFrame, settings: Settings = Settings()) -> DataFrame:
    det = F.col("det")
    kind = detector_kind(det["detection_type"])
    return explode_detections(valid).select(
        "tenant_id",
        "seq",
        "det_pos",
        "tokens",
        category_name(det["name"], det["code_name"]).alias("category"),
        kind.alias("kind"),
        total_entities(det["sensitive_entities"]).alias("n_entities"),
        distinct_entities(det["sensitive_entities"]).alias("n_distinct_entities"),
        suspicion_score(
            kind,
            F.col("tokens"),
            det["sensitive_entities"],
            det["entity_texts_with_subcategories"],
            settings,
        ).alias("score"),
    )


def category_profile(scored: DataFrame) -> DataFrame:
    """Counts, mean score and dominant kind of every category in one grouping.

    The dominant kind is the most frequent one, on a tie the one seen first. Kinds are a
    closed set of four, so they are pre-aggregated as a second, tiny level.
    """
    place = F.struct("seq", "det_pos")
    per_kind = scored.groupBy(*CATEGORY, "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("score").cast("decimal(20,3)")).alias("score_sum"),
        F.min(place).alias("first_seen"),
    )
    return (
        per_kind.groupBy(*CATEGORY)
        .agg(
            F.sum("n").alias("total_detections"),
            F.sum(F.when(F.col("kind") == "pattern", F.col("n")).otherwise(0)).alias(
                "pattern_detections"
            ),
            F.sum(F.when(F.col("kind") == "contextual", F.col("n")).otherwise(0)).alias(
                "contextual_detections"
            ),
            (F.sum("score_sum").cast("double") / F.sum("n")).alias("mean_prior"),
            F.max(
                F.struct(
                    "n",
                    (-F.col("first_seen.seq")).alias("a"),
                    (-F.col("first_seen.det_pos")).alias("b"),
                    "kind",
                )
            ).alias("top"),
            F.min("first_seen").alias("first_seen"),
        )
        .select(
            *CATEGORY,
            "total_detections",
            "pattern_detections",
            "contextual_detections",
            "mean_prior",
            F.bround("mean_prior", 3).alias("mean_heuristic_fp_prior"),
            F.col("top.kind").alias("dominant_detection_type"),
            F.col("first_seen.seq").alias("first_seq"),
            F.col("first_seen.det_pos").alias("first_pos"),
        )
    )


def most_suspicious(scored: DataFrame, n: int = 8) -> DataFrame:
    """The n highest scores per category, ties in input order.

    `rank <= n` over narrow rows: Spark keeps at most n rows per category and map task
    before it shuffles, so one category holding most rows does no harm.
    """
    order = Window.partitionBy(*CATEGORY).orderBy(F.desc("score"), "seq", "det_pos")
    return scored.withColumn("sample_rank", F.row_number().over(order)).where(
        F.col("sample_rank") <= n
    )


def existing_detections(valid: DataFrame) -> DataFrame:
    """Detections per name; only a missing name reads `Unknown`."""
    return (
        valid.select("tenant_id", F.explode("response_jsonl.name").alias("name"))
        .groupBy("tenant_id", F.coalesce("name", F.lit("Unknown")).alias("name"))
        .agg(F.count(F.lit(1)).alias("detections"))
    )
