"""Runs bound to a source: a file, or a time window of the log table."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from logveil.config import Settings
from logveil.plans.audit import FAILED, OK, Audit, failed, fp_outcomes, intent_outcomes
from logveil.plans.false_positives import FalsePositiveRun, run_false_positives
from logveil.plans.intent import IntentRun, run_intent
from logveil.plans.reports import message_counts
from logveil.scratch import stage
from logveil.sources.readers import (
    read_array_log,
    read_lines_log,
    read_table_log,
    read_window,
    require_tenants,
    window_bounds,
)
from logveil.sources.run_store import AUDIT, RunStore

log = logging.getLogger(__name__)

READERS = {"array": read_array_log, "lines": read_lines_log, "table": read_table_log}


@dataclass(frozen=True)
class BothRuns:
    intent: IntentRun | None
    intent_error: str | None
    false_positives: FalsePositiveRun


def file_records(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """Records of a file; JSON is parsed once and kept as a written table for the passes to come."""
    records = READERS[layout](spark, path)
    return records if layout == "table" else stage(records, "records")


def window_records(
    log_table: DataFrame,
    now: datetime,
    start: datetime | None = None,
    end: datetime | None = None,
    lookback_hours: int | None = None,
    tenants: DataFrame | None = None,
    settings: Settings = Settings(),
    known: DataFrame | None = None,
    skip_check: bool = False,
) -> DataFrame:
    """Records of a window of the log table, after checking that the tenants exist.

    `known` is a table of all tenants; without one the tenants of the whole log are looked up,
    which scans its `tenant_id`, and a tenant without a message counts as unknown.
    """
    if tenants is not None:
        require_tenants(tenants, log_table if known is None else known, skip_check)
        log_table = log_table.join(tenants.select("tenant_id").distinct(), "tenant_id", "left_semi")
    bounds = window_bounds(now, start, end, lookback_hours, settings.lookback_hours)
    return read_window(log_table, *bounds)


def run_both(
    records: DataFrame,
    intent_judge=None,
    fp_judge=None,
    max_clusters: int | None = None,
    max_categories: int | None = None,
    settings: Settings = Settings(),
    audit: Audit | None = None,
    **intent_options,
) -> BothRuns:
    """Both analyses over one read; when the first fails the second still runs."""
    intent, problem = None, None
    counts = stage(message_counts(records), "counts") if audit else None
    if audit:
        audit.run_start(counts, "intent", max_clusters)
    try:
        intent = run_intent(records, intent_judge, max_clusters, settings, **intent_options)
        if audit:
            audit.clusters(intent.payloads, intent.labels, settings.clustering)
            results = intent.report.results if intent.report else None
            audit.run_end(intent_outcomes(counts, intent.cleaned, results, settings.min_samples), "intent")
    except Exception as error:  # noqa: BLE001 - reported to the caller
        log.error("intent analysis failed: %s", error)
        problem, intent = str(error), None
        if audit:
            audit.run_end(failed(counts, problem), "intent")
    if audit:
        audit.run_start(counts, "fp", max_categories)
    try:
        fp = run_false_positives(records, fp_judge, max_categories, settings)
        if audit:
            audit.categories(fp.payloads)
            audit.run_end(fp_outcomes(counts, fp.report.results if fp.report else None), "fp")
    except Exception as error:
        if audit:
            audit.run_end(failed(counts, str(error)), "fp")
        raise
    return BothRuns(intent, problem, fp)


def run_and_save(
    records: DataFrame,
    store: RunStore,
    run_id: str,
    start: datetime,
    end: datetime,
    clock: Callable[[], datetime],
    judges: Callable[[Audit], tuple] = lambda audit: (None, None),
    max_clusters: int | None = None,
    max_categories: int | None = None,
    settings: Settings = Settings(),
    **intent_options,
) -> BothRuns:
    """Both analyses with their reports, audit trail and ledger rows, visible together or not at all.

    `judges` gets the audit trail of the run and gives the judges of the two analyses. Judged rows are
    written once, and the reports are made from them.
    """
    spark, attempt = records.sparkSession, store.begin(run_id)
    audit = Audit(attempt.path(AUDIT), clock())
    intent_judge, fp_judge = judges(audit)
    both = run_both(
        records, intent_judge, fp_judge, max_clusters, max_categories, settings, audit, **intent_options
    )
    attempt.tables.append(AUDIT)
    at = audit.at
    if both.intent:
        attempt.write("intent_status", both.intent.status)
        attempt.write("intent_payloads", both.intent.payloads)
        if report := both.intent.report:
            children = {"existing_detections": report.existing, "suggestions": report.suggestions}
            attempt.write_report("intent", report.summary, children, at)
            attempt.write("intent_results", report.results)
    attempt.write("fp_payloads", both.false_positives.payloads)
    if report := both.false_positives.report:
        attempt.write_report("fp", report.summary, {"action_required": report.actions}, at)
        attempt.write("fp_results", report.results)
    modes = [("intent", FAILED if both.intent_error else OK, both.intent_error), ("fp", OK, None)]
    attempt.commit(spark, start, end, clock(), modes)
    return both
