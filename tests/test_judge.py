"""Attempts, quotas, stored verdicts and rules."""

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from logveil.functions import judging
from logveil.operators import judge
from logveil.schema import CATEGORY_VERDICT, CLUSTER_VERDICT

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the judges run in workers


def flaky(batches):
    """Replies by name: at once, after being cut off, empty, or never."""
    for batch in batches:
        rows = []
        for key, request, attempt, budget in zip(
            batch["tenant_id"], batch["cluster_id"], batch["attempt"], batch["token_budget"]
        ):
            good = f'sure: {{"cluster_id": "x", "is_sensitive": true, "sensitivity_confidence": {budget / 10000}}}'
            reply, why = {
                "fine": (good, "stop"),
                "slow": (good, "stop") if attempt == 3 else ('{"cluster_id', "length"),
                "mute": (None, "stop"),
                "lost": ("no idea", "stop"),
                "down": ("timeout", "error"),
            }[request]
            rows.append((key, request, reply, why))
        yield pd.DataFrame(rows, columns=["tenant_id", "cluster_id", "reply", "finish_reason"])


def test_attempts(spark):
    names = ["fine", "slow", "mute", "lost", "down"]
    asked = spark.createDataFrame([("t", n, "q") for n in names], "tenant_id string, cluster_id string, request string")
    verdicts, log = judge.ask(asked, ["tenant_id", "cluster_id"], flaky, CLUSTER_VERDICT, 2200)
    got = {r["cluster_id"]: r["verdict"]["sensitivity_confidence"] for r in verdicts.collect()}
    assert got == {"fine": 0.22, "slow": 0.44}
    outcomes = {(r["cluster_id"], r["attempt"]): r["outcome"] for r in log.collect()}
    assert len(outcomes) == 1 + 4 * 3
    assert outcomes["fine", 1] == "ok" and outcomes["slow", 2] == "truncated_no_json"
    assert outcomes["mute", 3] == "empty_response" and outcomes["lost", 1] == "no_json_in_response"
    assert outcomes["down", 1] == "error" and outcomes["slow", 3] == "ok"


def raising(batches):
    """Answers the first rows, then raises at "boom"; never answers "skip"."""
    for batch in batches:
        for tenant, key in zip(batch["tenant_id"], batch["cluster_id"]):
            if key == "boom":
                raise RuntimeError("no connection")
            if key != "skip":
                row = (tenant, key, '{"is_sensitive": false}', "stop")
                yield pd.DataFrame([row], columns=["tenant_id", "cluster_id", "reply", "finish_reason"])


def test_failing_calls_are_logged_and_the_rest_goes_on(spark):
    names = ["a", "skip", "boom", "b"]
    asked = spark.createDataFrame(
        [("t", n, "q") for n in names], "tenant_id string, cluster_id string, request string"
    ).coalesce(1)
    verdicts, log = judge.ask(asked, ["tenant_id", "cluster_id"], raising, CLUSTER_VERDICT, 100, attempts=2)
    assert {r["cluster_id"] for r in verdicts.collect()} >= {"a"}
    outcomes = {(r["cluster_id"], r["attempt"]): r["outcome"] for r in log.collect()}
    assert outcomes["a", 1] == "ok" and ("a", 2) not in outcomes
    for name in ("skip", "boom"):
        assert outcomes[name, 1] == outcomes[name, 2] == "error"
    assert outcomes["b", 1] in ("ok", "error")


@pytest.mark.parametrize("quota", [None, 2, 3, 50])
def test_quota_is_first_successes(spark, quota):
    fails = {("a", 1), ("a", 3), ("b", 2), ("b", 3), ("b", 4)}
    ranked = spark.createDataFrame(
        [(t, r) for t in "ab" for r in range(1, 8)], "tenant_id string, rank bigint"
    )
    asked = []

    def run(rows):
        asked.append(rows.count())
        bad = spark.createDataFrame(list(fails), "tenant_id string, rank bigint").withColumn("bad", F.lit(True))
        return rows.join(bad, ["tenant_id", "rank"], "left").select("tenant_id", "rank", F.col("bad").isNull().alias("ok"))

    found = judge.first_successes(judge.ask_with_quota(ranked, quota, run), quota)
    got = {t: [r["rank"] for r in found.where(F.col("tenant_id") == t).orderBy("rank").collect()] for t in "ab"}
    for t in "ab":
        assert got[t] == [r for r in range(1, 8) if (t, r) not in fails][: quota or None]
    if quota == 2:
        assert got["a"] == [2, 4] and sum(asked) < 14


def test_category_rules(spark):
    row = dict.fromkeys(f.name for f in CATEGORY_VERDICT.fields) | {
        "dominant_detection_type": "pattern",
        "tuning_recommendation": "add_allowlist",
        "estimated_fp_rate": 0.7,
        "overall_assessment": "low_fp",
        "risk_of_disabling": "none",
        "per_example_verdicts": [{"verdict": "FP"}],
    }
    df = spark.createDataFrame([row], CATEGORY_VERDICT)
    assert set(df.select(judging.category_violations()).first()[0]) == {
        "pattern_tuning", "assessment_matches_rate", "disable_risk_known",
    }


def test_cluster_rules(spark):
    base = dict.fromkeys(f.name for f in CLUSTER_VERDICT.fields)
    good = base | {
        "cluster_id": "1", "is_sensitive": True, "risk_level": "high",
        "evidence_messages": ["abc", "bcd"],
        "example_triggering_phrases": ["a"], "example_counter_phrases": ["b"],
    }
    bad = good | {
        "cluster_id": "2", "risk_level": "huge", "evidence_messages": ["zzz"],
        "example_counter_phrases": [],
    }
    calm = base | {"cluster_id": "3", "is_sensitive": False, "intent_name": "left over", "evidence_messages": []}
    df = spark.createDataFrame([good, bad, calm], CLUSTER_VERDICT)
    df = df.withColumn("representative_messages", F.array(F.lit("xabcdx")))
    got = {r[0]: set(r[1]) for r in df.select("cluster_id", judging.cluster_violations()).collect()}
    assert got == {
        "1": set(),
        "2": {"evidence_count", "evidence_verbatim", "enough_counters", "risk_known"},
        "3": {"insensitive_is_blank"},
    }


def test_request_text(spark):
    df = spark.createDataFrame([("pii", 3)], "category string, n int")
    text = judging.request_text("about {category}: {payload}", F.struct("n"), category=F.col("category"))
    assert df.select(text).first()[0] == 'about pii: {"n":3}'
