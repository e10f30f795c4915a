"""From a message log to detector categories that need tuning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.config import Settings
from logveil.functions.judging import request_text
from logveil.operators.detections import CATEGORY
from logveil.operators.filters import valid_records
from logveil.operators.judge import ask, ask_with_quota, stored_category_results, with_payload
from logveil.operators.payloads import category_payloads, sampled_examples, scored_detections
from logveil.plans.audit import Audit
from logveil.plans.reports import FalsePositiveReport, fp_report, message_counts
from logveil.schema import CATEGORY_VERDICT
from logveil.scratch import stage

Results = Callable[[DataFrame], DataFrame]


def ranked_payloads(payloads: DataFrame) -> DataFrame:
    """Categories by mean score, ties in the order they were first seen."""
    order = Window.partitionBy("tenant_id").orderBy(F.desc("mean_prior"), "first_seq", "first_pos")
    return payloads.withColumn("rank", F.row_number().over(order))


def judge_categories(
    template: str, judge, settings: Settings = Settings(), audit: Audit | None = None
) -> Results:
    """A function from payload rows to result rows with `ok`, asking the given judge."""

    def run(payloads: DataFrame) -> DataFrame:
        shown = F.struct(
            "detection_category",
            "dominant_detection_type",
            "total_detections",
            "samples_shown",
            "mean_heuristic_fp_prior",
            "examples",
        )
        requests = payloads.withColumn(
            "request",
            request_text(
                template,
                shown,
                category=F.col("category"),
                det_type=F.col("dominant_detection_type"),
            ),
        )
        verdicts, attempts = ask(
            requests,
            CATEGORY,
            judge,
            CATEGORY_VERDICT,
            settings.fp_token_budget,
            settings.judge_attempts,
        )
        if audit:
            audit.judge_calls(attempts, requests, CATEGORY, "fp")
        found = with_payload(verdicts.select(*CATEGORY, "verdict.*"), payloads)
        return (
            payloads.select(*CATEGORY, "rank")
            .join(found.withColumn("ok", F.lit(True)), CATEGORY, "left")
            .fillna(False, ["ok"])
        )

    return run


def stored_categories(valid: DataFrame, verdicts: DataFrame, settings: Settings = Settings()) -> Results:
    """Judging by a table of verdicts per message over the sampled examples.

    The samples are drawn once and written; every wave of categories is joined with them.
    """
    drawn: list[DataFrame] = []

    def run(payloads: DataFrame) -> DataFrame:
        if not drawn:
            examples = sampled_examples(valid, scored_detections(valid, settings), settings)
            drawn.append(stage(examples.drop("example"), "samples"))
        found = stored_category_results(payloads, drawn[0], verdicts)
        return (
            payloads.select(*CATEGORY, "rank")
            .join(found.withColumn("ok", F.lit(True)), CATEGORY)
        )

    return run


@dataclass(frozen=True)
class FalsePositiveRun:
    status: DataFrame
    payloads: DataFrame
    report: FalsePositiveReport | None


def run_false_positives(
    records: DataFrame,
    judge: Results | None = None,
    max_categories: int | None = None,
    settings: Settings = Settings(),
) -> FalsePositiveRun:
    """The whole analysis; without a judge it ends at the payloads of all categories."""
    valid = valid_records(records)
    status = message_counts(records).select(
        "tenant_id",
        F.when(
            F.col("messages_with_existing_detection") == 0, F.lit("No detected messages found")
        )
        .otherwise(F.lit("ok"))
        .alias("fp_status"),
    )
    if judge is None:
        return FalsePositiveRun(status, category_payloads(valid, settings, 1), None)
    payloads = stage(category_payloads(valid, settings), "payloads")
    judged = ask_with_quota(ranked_payloads(payloads), max_categories, judge)
    results = stage(judged.where("ok").drop("ok", "rank"), "results")
    return FalsePositiveRun(status, payloads, fp_report(records, results))
