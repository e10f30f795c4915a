"""Judging payload rows with a function of the user's, or with a stored verdict table."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.functions.judging import assessment, extrapolated_fp, json_in_text, rate_from_tally
from logveil.operators.detections import CATEGORY
from logveil.scratch import stage

# gets (keys, request, attempt, token_budget), gives (keys, reply, finish_reason)
Judge = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# Share of the token budget per attempt.
BUDGET_STEPS = (1.0, 1.5, 2.0)


def _guarded(judge: Judge, keys: list[str]) -> Judge:
    """`judge`, one batch at a time; a row it raises on or leaves out is a failed call.

    What a batch gave before it raised is kept, so no answered question is asked again. Rows get the time
    from the call to the answer they came in.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            open_keys, begun = frame[keys].copy(), time.perf_counter()
            took = lambda: round(1000 * (time.perf_counter() - begun), 1)  # noqa: B023, E731
            try:
                for answers in judge(iter([frame])):
                    seen = answers[keys].drop_duplicates()
                    marked = open_keys.merge(seen, on=keys, how="left", indicator=True)
                    open_keys = marked.loc[marked["_merge"] == "left_only", keys]
                    yield answers.assign(latency_ms=took())
            except Exception:
                logging.getLogger(__name__).exception("the judge failed on %d rows", len(open_keys))
            if len(open_keys):
                yield open_keys.assign(reply=None, finish_reason="error", latency_ms=took())

    return run


def ask(
    requests: DataFrame,
    keys: list[str],
    judge: Judge,
    verdict: T.StructType,
    token_budget: int,
    attempts: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts and the log of attempts for `requests(keys..., request)`.

    Replies are written down before anything else reads them, so no question is asked twice
    because a later step was repeated. Only failed rows go into the next attempt, with a
    larger budget. Rows that never give a readable verdict are missing from the result. A judge
    that raises, or gives no answer for a row, costs that row's attempt, logged as `error`.
    """
    reply_schema = T.StructType(
        [requests.schema[k] for k in keys]
        + [T.StructField("reply", T.StringType()), T.StructField("finish_reason", T.StringType())]
        + [T.StructField("latency_ms", T.DoubleType())]
    )
    asked = requests.select(*keys, "request")
    log, good = [], []
    for attempt in range(1, attempts + 1):
        step = BUDGET_STEPS[min(attempt, len(BUDGET_STEPS)) - 1]
        sent = asked.withColumn("attempt", F.lit(attempt)).withColumn(
            "token_budget", F.lit(int(token_budget * step))
        )
        found = json_in_text(F.col("reply"))
        usable = F.col("verdict").isNotNull() & F.ltrim("found").startswith("{")
        answered = stage(
            sent.mapInPandas(_guarded(judge, keys), reply_schema)
            .withColumn("found", found)
            .withColumn("verdict", F.from_json("found", verdict))
            .withColumn("attempt", F.lit(attempt))
            .withColumn(
                "outcome",
                F.when(usable, F.lit("ok"))
                .when(F.col("finish_reason") == "error", F.lit("error"))
                .when(F.coalesce(F.length("reply"), F.lit(0)) == 0, F.lit("empty_response"))
                .when(F.col("finish_reason") == "length", F.lit("truncated_no_json"))
                .otherwise(F.lit("no_json_in_response")),
            ),
            "replies",
        )
        parsed = F.when(F.col("outcome") == "ok", F.to_json("verdict"))
        log.append(answered.withColumn("parsed", parsed).drop("verdict", "found"))
        good.append(answered.where("outcome = 'ok'").select(*keys, "verdict"))
        asked = asked.join(good[-1].select(*keys), keys, "left_anti")
        if attempt < attempts and asked.isEmpty():
            break
    return reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, log)


def first_successes(results: DataFrame, quota: int | None, order: str = "rank") -> DataFrame:
    """The first `quota` successful rows per tenant in rank order; all when quota is falsy."""
    ok = results.where("ok")
    if not quota:
        return ok
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(order))
    return ok.withColumn("_place", place).where(F.col("_place") <= quota).drop("_place")


def ask_with_quota(
    ranked: DataFrame, quota: int | None, run: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Judge down the ranked list until each tenant has `quota` successes or runs out.

    `ranked` has tenant_id and rank from 1; `run` returns its rows with a flag `ok`. Each
    further wave takes as many rows as are missing, so no more is asked than needed.
    """
    if not quota:
        return stage(run(ranked), "judged")
    judged, sent = [], []
    wave = stage(ranked.where(F.col("rank") <= quota), "wave")
    while not wave.isEmpty():
        judged.append(stage(run(wave), "judged"))
        sent.append(wave.select("tenant_id", "rank", F.lit(False).alias("ok")))  # also what got no row
        so_far = (
            reduce(DataFrame.unionByName, [*sent, *(j.select("tenant_id", "rank", "ok") for j in judged)])
            .groupBy("tenant_id")
            .agg(F.count_if("ok").alias("got"), F.max("rank").alias("upto"))
            .where(F.col("got") < quota)
        )
        wave = stage(
            ranked.join(so_far, "tenant_id")
            .where(
                (F.col("rank") > F.col("upto"))
                & (F.col("rank") <= F.col("upto") + quota - F.col("got"))
            )
            .select(*ranked.columns),
            "wave",
        )
    return reduce(DataFrame.unionByName, judged) if judged else run(ranked)


# ------------------------------------------------------------- verdict tables


def verdict_tally(examples: DataFrame) -> DataFrame:
    """FP / TP / UNCERTAIN counts of judged examples per category."""
    return examples.groupBy(*CATEGORY).agg(
        *[
            F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}")
            for v in ("FP", "TP", "UNCERTAIN")
        ]
    )


def stored_category_results(
    payloads: DataFrame, examples: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Category results from a table of verdicts (seq, verdict) over the shown examples.

    Rate, assessment and counts follow from the tally; tuning advice is the mildest one the
    detector kind allows for its assessment.
    """
    judged = examples.join(verdicts.select("seq", "verdict"), "seq", "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit("UNCERTAIN"))
    )
    rate = rate_from_tally(F.col("n_fp"), F.col("n_tp"))
    decided = (F.col("n_fp") + F.col("n_tp")) / (
        F.col("n_fp") + F.col("n_tp") + F.col("n_uncertain")
    )
    tuning = F.when(~F.col("overall_assessment").isin("high_fp", "moderate_fp"), "no_action").when(
        F.col("dominant_detection_type") == "pattern", "tighten_regex"
    ).otherwise("reduce_scope")
    return with_payload(
        verdict_tally(judged)
        .withColumn("estimated_fp_rate", rate)
        .withColumn("fp_rate_confidence", decided)
        .withColumn("overall_assessment", assessment(F.col("estimated_fp_rate")))
        .withColumnRenamed("n_fp", "estimated_fp_count_in_sample")
        .withColumnRenamed("n_tp", "estimated_tp_count_in_sample"),
        payloads,
    ).withColumn("tuning_recommendation", tuning)


def with_payload(results: DataFrame, payloads: DataFrame) -> DataFrame:
    """Give category results the figures of their own payload and the extrapolated counts."""
    total = F.col("total_detections_in_period")
    fp = extrapolated_fp(F.col("estimated_fp_rate"), total)
    figures = payloads.select(
        *CATEGORY,
        "dominant_detection_type",
        F.col("total_detections").alias("total_detections_in_period"),
        "mean_prior",
        "mean_heuristic_fp_prior",
        "first_seq",
        "first_pos",
    )
    own = [c for c in results.columns if c not in figures.columns or c in CATEGORY]
    return (
        results.select(*own)
        .join(figures, CATEGORY)
        .withColumn("estimated_fp_count_total", fp)
        .withColumn("estimated_tp_count_total", total - fp)
    )


def stored_cluster_results(payloads: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cluster results from a table keyed by our own (tenant_id, cluster_id)."""
    figures = payloads.select(
        "tenant_id", "label", "cluster_id", "message_count", "top_keywords", "date_range"
    )
    own = [c for c in verdicts.columns if c not in ("label", "message_count", "top_keywords", "date_range")]
    return verdicts.select(*own).join(figures, ["tenant_id", "cluster_id"])
