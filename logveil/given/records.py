"""A message log derived from the given tables, and the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.scratch import spread, stage

# Detectors of the derived log, (name, raw detection type, pattern).
# The edges are spelled out so that they mean the same in every regex dialect.
# A pattern is searched only in texts that hold its mark, which is part of every match.
_EDGE_L, _EDGE_R = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
DETECTORS = [
    ("Card Number", "pattern", _EDGE_L + "[0-9]{16}" + _EDGE_R),
    ("IP Address", "pattern", _EDGE_L + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + _EDGE_R),
    ("Phone Number", "PATTERN ", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"),
    ("Email Address", "pattern", "[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+"),
    ("API Token", "semantic", 'token = "[0-9a-f]{40}"'),
    ("License Notice", "ml", "[Ll]icen[sc]e"),
]

MARKS = {"IP Address": ".", "Phone Number": ") 555-", "Email Address": "@", "API Token": 'token = "', "License Notice": "icen"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minute_stamp(minutes: Column) -> Column:
    """ISO text of 2024-01-01 plus some minutes, the same in every session time zone."""
    moment = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + minutes * F.expr("interval 1 minute")
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def _hits(name: str, pattern: str) -> Column:
    found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    if name not in MARKS:
        return found
    return F.when(F.contains("text", F.lit(MARKS[name])), found).otherwise(F.array().cast("array<string>"))


def _subtype(name: str, entity: Column) -> Column:
    if name != "Email Address":
        return F.lit(name.upper())
    last_digit = F.right(F.regexp_extract(entity, "[0-9]+", 0), F.lit(1))
    return F.when(last_digit.isin("0", "2", "4", "6", "8"), F.lit("UPI ID")).otherwise(
        F.lit("EMAIL")
    )


def _detection(name: str, raw_type: str, hits: Column, fires: Column) -> Column:
    distinct = F.array_distinct(hits)
    return F.when(
        fires,
        F.struct(
            F.concat(F.col("seq").cast("string"), F.lit(":" + name)).alias("id"),
            F.lit(name).alias("name"),
            F.lit(name.upper().replace(" ", "_")).alias("code_name"),
            F.lit("message").alias("type"),
            F.lit(raw_type).alias("detection_type"),
            F.concat(F.lit("hits: "), F.size(hits).cast("string")).alias("reason"),
            hits.alias("sensitive_entities"),
            F.map_from_arrays(
                distinct, F.transform(distinct, lambda e: _subtype(name, e))
            ).alias("entity_texts_with_subcategories"),
        ),
    )


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as a message log: one tenant per language, detections found by pattern."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    base = docs.join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("tenant_id"),
        F.col("text").alias("input_text"),
        # some rows carry an error and some lack a time stamp, as in a real log
        F.when(F.col("doc_id") % 50 == 7, F.lit("timeout")).alias("errors"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("event_ts"),
        F.when(F.col("doc_id") % 10 == 3, F.lit(""))
        .otherwise(minute_stamp(F.col("doc_id")))
        .alias("created_at"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("toxic"),
        *[
            _hits(name, pattern).alias(f"hits_{i}")
            for i, (name, _, pattern) in enumerate(DETECTORS)
        ],
    )
    none = F.array().cast("array<string>")
    found = [
        _detection(name, kind, F.col(f"hits_{i}"), F.size(f"hits_{i}") > 0)
        for i, (name, kind, _) in enumerate(DETECTORS)
    ] + [_detection("Toxic Content", "contextual", none, F.col("toxic"))]
    return base.select(
        "tenant_id",
        "seq",
        "created_at",
        "event_ts",
        "input_text",
        "errors",
        F.array_compact(F.array(*found)).alias("response_jsonl"),
    )


_landed: dict[tuple[str, str], DataFrame] = {}


def landed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log as a written table, made once per session and folder.

    The queries read it as a log is read in production: stored with its detections, so that
    scans take only the columns they need and no pattern is matched twice.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        _landed[key] = stage(message_log(spark, sf_dir), "message_log", "zstd")
    return _landed[key]


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored verdict per message: the verdict-table judge reads it."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("quality") == 0, F.lit("TP"))
        .when(F.col("quality") == 1, F.lit("FP"))
        .otherwise(F.lit("UNCERTAIN"))
        .alias("verdict"),
    )
