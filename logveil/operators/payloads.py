"""What a judge gets to see: one row per cluster, one row per detection category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.config import Settings
from logveil.functions.detections import detection_view
from logveil.functions.snippets import entity_hits, snippet
from logveil.functions.text import was_truncated
from logveil.operators.clustering import cluster_name, representatives
from logveil.operators.detections import (
    CATEGORY,
    category_profile,
    most_suspicious,
    scored_detections,
)
from logveil.operators.filters import frequent_categories
from logveil.operators.keywords import keyword_lists, top_keywords
from logveil.scratch import stage

KEY = ["tenant_id", "seq"]
CLUSTER = ["tenant_id", "label"]


def cluster_dates(messages: DataFrame) -> DataFrame:
    """Size of each cluster, first and last non-empty time stamp (compared as text)."""
    stamp = F.nullif(F.col("created_at"), F.lit(""))
    return messages.groupBy(*CLUSTER).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min(stamp).alias("date_from"),
        F.max(stamp).alias("date_to"),
    )


def cluster_payloads(
    messages: DataFrame, labelled: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """One row per (tenant_id, label), noise included.

    `messages` has tenant_id, seq, created_at and clean_text; `labelled` has tenant_id, seq,
    label and vec. Texts are joined to the chosen representatives only, and to the labels where their
    words are counted; they are not written again. The narrow labels are hashed, so the texts need not be sorted.
    """
    labels = labelled.select(*KEY, "label").hint("shuffle_hash")
    texts = messages.select(*KEY, "created_at", "clean_text").join(labels, KEY)
    nearest = representatives(labelled, settings.representatives)
    nearest = stage(labelled.select(*KEY).join(nearest, KEY), "nearest")
    shown = (
        messages.select(*KEY, "clean_text")
        .join(nearest, KEY)
        .groupBy(*CLUSTER)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", "clean_text"))),
                lambda r: r["clean_text"],
            ).alias("representative_messages")
        )
    )
    words = keyword_lists(top_keywords(texts, settings.keywords, settings.vocabulary))
    none = F.array().cast("array<string>")
    return (
        cluster_dates(texts)
        .join(words, CLUSTER, "left")
        .join(shown, CLUSTER)
        .select(
            *CLUSTER,
            cluster_name(F.col("label")).alias("cluster_id"),
            "message_count",
            F.struct(F.col("date_from").alias("from"), F.col("date_to").alias("to")).alias(
                "date_range"
            ),
            F.coalesce("top_keywords", none).alias("top_keywords"),
            "representative_messages",
        )
    )


def sampled_examples(
    valid: DataFrame, scored: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """The sampled detections with snippet and details, texts fetched for the samples only."""
    # written down so that its size is known: the few samples are broadcast to the texts
    top = stage(
        most_suspicious(scored, settings.samples_per_category).select(
            *CATEGORY, "seq", "det_pos", "sample_rank", "score"
        ),
        "samples",
    )
    text = F.coalesce(F.col("input_text"), F.lit(""))
    picked = valid.join(top, KEY).withColumn("det", F.get("response_jsonl", F.col("det_pos")))
    hits = picked.withColumn("hits", entity_hits(text, F.col("det.sensitive_entities")))
    return hits.select(
        *CATEGORY,
        "seq",
        "det_pos",
        "sample_rank",
        F.struct(
            snippet(
                F.col("input_text"),
                F.col("hits"),
                settings.context_window,
                settings.snippet_limit,
            ).alias("input_text"),
            was_truncated(F.col("input_text"), settings.snippet_limit).alias(
                "input_was_truncated"
            ),
            detection_view(F.col("det")).alias("full_detection"),
            F.col("score").alias("heuristic_fp_score"),
        ).alias("example"),
    )


def category_payloads(
    valid: DataFrame, settings: Settings = Settings(), min_occurrences: int | None = None
) -> DataFrame:
    """One row per (tenant_id, category) with its few examples in sample order."""
    scored = scored_detections(valid, settings)
    least = settings.min_occurrences if min_occurrences is None else min_occurrences
    profile = frequent_categories(category_profile(scored), least)
    examples = (
        sampled_examples(valid, scored, settings)
        .groupBy(*CATEGORY)
        .agg(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("sample_rank", "seq", "det_pos", "example")),
                    lambda a, b: a["sample_rank"] - b["sample_rank"],
                ),
                lambda e: e["example"],
            ).alias("examples")
        )
    )
    return profile.join(examples, CATEGORY).select(
        *CATEGORY,
        F.col("category").alias("detection_category"),
        "dominant_detection_type",
        "total_detections",
        F.size("examples").alias("samples_shown"),
        "mean_prior",
        "mean_heuristic_fp_prior",
        "first_seq",
        "first_pos",
        "examples",
    )
