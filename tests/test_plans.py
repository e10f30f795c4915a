"""The composed jobs on a small log."""

import json
import sys
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from logveil.config import Settings
from logveil.given.records import landed_log, verdicts
from logveil.operators.filters import valid_records
from logveil.plans import false_positives, intent, runs
from logveil.plans.audit import Audit
from logveil.sources import ledger, writers
from logveil.sources.run_store import Attempt, RunStore
from logveil.sources.readers import window_bounds
from logveil.operators import embedding

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the judges run in workers


def sensitive_judge(batches):
    for batch in batches:
        replies = []
        for request in batch["request"]:
            payload = json.loads(request)
            replies.append(
                json.dumps(
                    {
                        "cluster_id": "ignored",
                        "is_sensitive": payload["message_count"] > 2,
                        "sensitivity_confidence": 0.9,
                        "risk_level": "high",
                    }
                )
            )
        yield batch[["tenant_id", "cluster_id"]].assign(reply=replies, finish_reason="stop")


def fp_judge(batches):
    for batch in batches:
        reply = json.dumps({"estimated_fp_rate": 0.5, "overall_assessment": "moderate_fp"})
        yield batch[["tenant_id", "category"]].assign(reply=reply, finish_reason="stop")


@pytest.fixture(scope="module")
def log(spark, small):
    return landed_log(spark, small)


def test_both_analyses(spark, log, tmp_path):
    settings = Settings(eps=0.6)
    trail = Audit(str(tmp_path / "audit"), datetime(2024, 1, 1))
    both = runs.run_both(
        log,
        intent.judge_clusters("{payload}", sensitive_judge, settings, trail),
        false_positives.judge_categories("{category} {det_type} {payload}", fp_judge, settings, trail),
        max_clusters=2,
        settings=settings,
        audit=trail,
    )
    events = {r["event"]: r["count"] for r in spark.read.json(trail.path).groupBy("event").count().collect()}
    assert set(events) == {"run_start", "run_end", "llm_call", "cluster_built", "cluster_summary", "fp_category"}
    trail_rows = spark.read.json(trail.path)
    calls = trail_rows.where("event = 'llm_call'").select("context", "request", "reply", "parsed", "latency_ms").collect()
    assert {r["context"] for r in calls} == {"intent", "fp"}
    assert all(r["request"] and r["reply"] and r["parsed"].startswith("{") and r["latency_ms"] >= 0 for r in calls)
    ends = {(r["mode"], r["tenant_id"]): r for r in trail_rows.where("event = 'run_end'").collect()}
    assert {r["status"] for r in ends.values()} <= {"ok", "too_few_messages", "no_undetected", "no_detected"}
    assert ends["intent", "en"]["clusters_analyzed"] == 2
    labels = trail_rows.where("event = 'cluster_summary' and tenant_id = 'en'").first()
    assert sum(x["message_count"] for x in labels["label_counts"]) == labels["n_messages"]
    assert events["cluster_built"] == both.intent.payloads.count()
    report = both.intent.report
    counts = report.results.groupBy("tenant_id").count().collect()
    assert both.intent_error is None and counts and all(r["count"] <= 2 for r in counts)
    assert [r["rank"] for r in report.suggestions.where("tenant_id = 'en'").orderBy("rank").collect()] == [1, 2]
    summary = {r["tenant_id"]: r for r in report.summary.collect()}
    for r in summary.values():
        assert r["total_messages"] == r["messages_with_existing_detection"] + r["messages_without_detection"]
        assert r["messages_without_detection"] == r["clustered_messages"] + r["dropped_in_preprocessing"]
    sizes = both.intent.payloads.groupBy("tenant_id").agg(F.sum("message_count").alias("n")).collect()
    assert {r["tenant_id"]: r["n"] for r in sizes} == {
        t: r["clustered_messages"] for t, r in summary.items() if r["clustered_messages"] >= 3
    }
    fp = both.false_positives.report
    got = fp.actions.collect()
    assert got and all(r["estimated_fp_total"] + r["estimated_tp_total"] == r["total_detections"] for r in got)
    path = writers.write_report(
        fp.summary, {"action_required": fp.actions}, str(tmp_path), "fp", window_bounds(pd.Timestamp("2024-01-01"))[1]
    )
    assert writers.report_rows(writers.read_report(spark, path), "action_required").count() == len(got)


def test_runs_are_saved_whole_or_not_at_all(spark, log, tmp_path, monkeypatch):
    store, settings = RunStore(str(tmp_path / "store")), Settings(eps=0.6)
    hours = iter(range(1, 100))
    clock = lambda: datetime(2024, 1, 1) + timedelta(hours=next(hours))
    judges = lambda audit: (
        intent.judge_clusters("{payload}", sensitive_judge, settings, audit),
        false_positives.judge_categories("{category} {det_type} {payload}", fp_judge, settings, audit),
    )

    def save(run_id):
        at = datetime(2024, 1, 1)
        return runs.run_and_save(log, store, run_id, at - timedelta(hours=72), at, clock, judges, settings=settings)

    plain = Attempt.write

    def killed(self, table, rows):
        if table == "fp_summary":
            raise KeyboardInterrupt
        return plain(self, table, rows)

    monkeypatch.setattr(Attempt, "write", killed)
    with pytest.raises(KeyboardInterrupt):
        save("a")
    assert store.read(spark, "intent_suggestions") is None and store.ledger(spark).isEmpty()
    monkeypatch.setattr(Attempt, "write", plain)
    both = save("a")
    save("a")
    assert store.read(spark, "intent_suggestions").count() == both.intent.report.suggestions.count() > 0
    documents = store.read(spark, "fp_documents").collect()
    assert {r["run_id"] for r in documents} == {"a"} and any("action_required" in r["document"] for r in documents)
    assert store.read(spark, "audit").where("event = 'run_end'").select("run_id", "mode").distinct().count() == 2
    done = store.ledger(spark)
    assert sorted((r["mode"], r["status"]) for r in done.collect()) == [("fp", "ok"), ("intent", "ok")]
    assert ledger.last_success(done).first()["last_run"] is not None
    assert store.expire(spark, datetime.now() + timedelta(hours=1)) == 2
    assert store.expire(spark, datetime.now() + timedelta(hours=1)) == 0
    assert store.read(spark, "fp_action_required").count() == both.false_positives.report.actions.count()


def test_failed_intent_does_not_stop_the_other(log):
    def broken(messages):
        raise RuntimeError("no model")

    both = runs.run_both(log, settings=Settings(), embed=broken)
    assert both.intent is None and "no model" in both.intent_error
    assert both.false_positives.payloads.count() > 0


def test_without_judge_rare_categories_stay(spark, log):
    everything = false_positives.run_false_positives(log).payloads
    valid = valid_records(log)
    judged = false_positives.run_false_positives(
        log, false_positives.stored_categories(valid, verdicts(spark, "/root/testdata/sf0.001"))
    )
    assert everything.where("total_detections = 1").count() > 0
    assert judged.payloads.where("total_detections = 1").count() == 0


def test_small_tenants_are_left_out(log):
    run = intent.run_intent(log, settings=Settings(min_samples=40))
    status = {r["tenant_id"]: r["intent_status"] for r in run.status.collect()}
    assert status["en"] == "ok" and "not enough to cluster" in status["de"]
    assert {r["tenant_id"] for r in run.payloads.collect()} == {"en"}


def test_embedding_with_a_model_and_reduction(spark):
    df = spark.createDataFrame([("t", i, f"word{i} x") for i in range(10)], "tenant_id string, seq bigint, clean_text string")

    def load():
        return lambda texts: [[float(len(t)), float(t.count("x")), 1.0] for t in texts]

    embedded = embedding.embed_with(df, load, batch=3)
    assert embedded.select(F.size("vec")).distinct().collect()[0][0] == 3
    assert embedding.reduced_vectors(embedded, 2).select(F.size("vec")).first()[0] == 2


def test_hashed_vectors_of_a_tenant_do_not_depend_on_others(spark):
    texts = ["red fox runs", "red hen runs", "blue owl", ""]
    alone = spark.createDataFrame(
        [("a", i, t) for i, t in enumerate(texts)], "tenant_id string, seq bigint, clean_text string"
    )
    others = spark.createDataFrame(
        [("b", 10 + i, "blue owl red") for i in range(9)] + [(None, 30, "hen")], alone.schema
    )
    read = lambda df: {r["seq"]: r["vec"] for r in embedding.hashed_vectors(df).collect()}
    own, among = read(alone), read(alone.unionByName(others))
    assert len(among) == 14 and {i: among[i] for i in own} == own
    assert sum(x * x for x in own[0]) == pytest.approx(1.0, abs=1e-5) and not any(own[3])


def test_known_tenants_come_from_their_table(spark, log):
    asked = spark.createDataFrame([("en",), ("silent",)], "tenant_id string")
    window = dict(now=datetime(2030, 1, 1), start=datetime(2000, 1, 1), tenants=asked)
    with pytest.raises(ValueError):
        runs.window_records(log, **window)
    by_table = runs.window_records(log, **window, known=asked)
    skipped = runs.window_records(log, **window, skip_check=True)
    assert by_table.count() == skipped.count() > 0


def test_unknown_options():
    with pytest.raises(ValueError):
        Settings(dedup_method="simhash")
    with pytest.raises(ValueError):
        Settings(clustering="kmeans")
