"""One query per operator or group of operators, over whole tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logveil.config import Settings
from logveil.functions import judging, snippets, text, vectors
from logveil.given import derived
from logveil.given.records import landed_log, table, verdicts
from logveil.operators import (
    clustering,
    dedup,
    detections,
    embedding,
    filters,
    judge,
    keywords,
    neighbours,
    payloads,
)
from logveil.plans import explorer, false_positives, intent, reports
from logveil.plans.audit import Audit, fp_outcomes
from logveil.schema import CATEGORY_VERDICT
from logveil.scratch import shared_folder, spread, stage
from logveil.sources import ledger, readers, writers
from logveil.sources.run_store import RunStore
from logveil.streaming.ingest import ingest
from logveil.streaming.windows import detection_rate_by_window

EPS = 0.65  # the given vectors have no neighbours at the default of 0.35
FIXED_RUN = datetime(2024, 2, 1)
c = F.col


def _six(value):
    return F.round(value, 6)


def _micros(moment):
    return F.unix_micros(moment.cast("timestamp"))


def _flat(rows: DataFrame, array: str, name: str, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(array).alias("place", name))


# ----------------------------------------------------------- detections, filters


def suspicious_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = detections.scored_detections(derived.valid_log(spark, sf_dir))
    return detections.most_suspicious(scored).select(
        "tenant_id", "category", "sample_rank", "seq", "det_pos", "kind", "tokens", "score"
    )


def message_split(spark, sf_dir):
    return reports.detection_rate(reports.message_counts(landed_log(spark, sf_dir)))


def split_and_union(spark, sf_dir):
    """Detected and undetected parts put together again, with their sizes in characters."""
    valid = derived.valid_log(spark, sf_dir)
    return (
        filters.detected(valid)
        .unionByName(filters.undetected(valid))
        .groupBy("tenant_id", "is_detected")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.sum(F.length("input_text")).alias("characters"),
        )
    )


def existing_detections(spark, sf_dir):
    return explorer.detector_ranking(
        detections.existing_detections(derived.valid_log(spark, sf_dir))
    )


def detection_rows(spark, sf_dir):
    scored = detections.scored_detections(derived.valid_log(spark, sf_dir))
    return scored.select(
        "tenant_id",
        "seq",
        "det_pos",
        "category",
        "kind",
        "n_entities",
        "n_distinct_entities",
        "score",
    )


def category_profile(spark, sf_dir):
    scored = detections.scored_detections(derived.valid_log(spark, sf_dir))
    profile = filters.frequent_categories(detections.category_profile(scored))
    return false_positives.ranked_payloads(profile).select(
        "tenant_id",
        "category",
        "rank",
        "total_detections",
        "pattern_detections",
        "contextual_detections",
        "dominant_detection_type",
        _six(c("mean_prior")).alias("mean_prior"),
        "mean_heuristic_fp_prior",
    )


def detection_rate_72h(spark, sf_dir):
    windows = detection_rate_by_window(derived.valid_log(spark, sf_dir), 72)
    return windows.withColumn("window_start", F.unix_timestamp("window_start")).withColumn(
        "window_end", F.unix_timestamp("window_end")
    )


# ------------------------------------------------------------------------- text


def normalized_tokens(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        text.token_count(c("text")).alias("tokens"),
        F.md5(text.normalize_space(c("text"))).alias("clean_md5"),
    )


def shingle_sets(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).withColumn(
        "shingles", text.word_shingles(text.normalize_space(c("text")))
    )
    return docs.select(
        "doc_id",
        F.size("shingles").alias("n_shingles"),
        F.md5(F.array_join(F.sort_array("shingles"), "|")).alias("shingles_md5"),
    )


def turn_overlap(spark, sf_dir):
    """How much of its words and shingles each turn shares with the turn before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    clean = text.normalize_space(c("text"))
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.word_shingles(clean, 1).alias("words"),
        text.word_shingles(clean).alias("shingles"),
    )
    before = turns.withColumn("words_before", F.lag("words").over(order)).withColumn(
        "shingles_before", F.lag("shingles").over(order)
    )
    return before.where("words_before is not null").select(
        "conv_id",
        "turn",
        _six(text.jaccard(c("words"), c("words_before"))).alias("word_overlap"),
        _six(text.jaccard(c("shingles"), c("shingles_before"))).alias("shingle_overlap"),
    )


def head_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length(text.head_tail(c("text"))).alias("shown_chars"),
        F.md5(text.head_tail(c("text"))).alias("shown_md5"),
        text.was_truncated(c("text")).alias("truncated"),
    )


def json_in_text(spark, sf_dir):
    return derived.wrapped_json(spark, sf_dir).select(
        "event_id", judging.json_in_text(c("raw")).alias("found")
    )


# ------------------------------------------------------------ near-duplicates


def dedup_jaccard(spark, sf_dir):
    return intent.preprocess(derived.valid_log(spark, sf_dir)).select(
        "tenant_id",
        "seq",
        text.token_count(c("clean_text")).alias("tokens"),
        F.md5("clean_text").alias("clean_md5"),
    )


def dedup_minhash(spark, sf_dir):
    settings = Settings(dedup_method="minhash")
    return intent.preprocess(derived.valid_log(spark, sf_dir), settings).select(
        "tenant_id", "seq", text.token_count(c("clean_text")).alias("tokens")
    )


def burst_first_wins(spark, sf_dir):
    """First wins over a conflict graph: an event conflicts with the user's previous one
    when at most ten minutes lie between them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(
        c("user_id").cast("string").alias("tenant_id"),
        F.lag("event_id").over(order).alias("lo"),
        c("event_id").alias("hi"),
        (_micros(c("ts")) - _micros(F.lag("ts").over(order))).alias("apart"),
    )
    edges = steps.where((c("apart") <= 600_000_000) & (c("lo") < c("hi")))
    return dedup.first_wins(edges.select("tenant_id", "lo", "hi")).select("tenant_id", "seq")


def funnel(spark, sf_dir):
    log = landed_log(spark, sf_dir)
    return reports.funnel(log, intent.preprocess(filters.valid_records(log)))


def run_status(spark, sf_dir):
    return filters.run_status(funnel(spark, sf_dir), min_samples=100)


# ------------------------------------------------------------------- clustering


def unit_vectors(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(vectors.unit(c("embedding"))).alias("dim", "x")
    )
    return points.select("vec_id", "dim", _six(c("x")).alias("x"))


def eps_edges(spark, sf_dir):
    return neighbours.close_pairs(derived.embedded_points(spark, sf_dir), EPS).select(
        "lo", "hi", _six(c("distance")).alias("distance")
    )


def _labels(spark, sf_dir):
    return clustering.dbscan(derived.embedded_points(spark, sf_dir), EPS, 3)


def dbscan_labels(spark, sf_dir):
    return _labels(spark, sf_dir).select(
        "seq", "label", "is_core", clustering.cluster_name(c("label")).alias("cluster_id")
    )


def cluster_sizes(spark, sf_dir):
    sizes = clustering.cluster_sizes(_labels(spark, sf_dir))
    return sizes.select("label", "cluster_id", "message_count").orderBy(
        F.desc("message_count"), "label"
    )


def cluster_summary(spark, sf_dir):
    return clustering.cluster_summary(_labels(spark, sf_dir)).drop("tenant_id")


def centroids(spark, sf_dir):
    found = clustering.centroids(derived.embedded_points(spark, sf_dir))
    return _flat(found, "centroid", "x", "label").withColumn("x", _six(c("x")))


def representatives(spark, sf_dir):
    found = clustering.representatives(derived.embedded_points(spark, sf_dir))
    return found.select("label", "place", "seq", _six(c("distance")).alias("distance"))


def cluster_dates(spark, sf_dir):
    return payloads.cluster_dates(derived.cleaned_documents(spark, sf_dir)).drop("tenant_id")


def hashed_embedding(spark, sf_dir):
    messages = derived.cleaned_documents(spark, sf_dir)
    return embedding.hashed_vectors(messages).select(
        "seq",
        F.size("vec").alias("dimensions"),
        F.round(vectors.length(c("vec")), 3).alias("length"),
    )


def reduced_embedding(spark, sf_dir):
    points = derived.embedded_points(spark, sf_dir)
    return embedding.reduced_vectors(points, 8).select("seq", F.size("vec").alias("dimensions"))


# --------------------------------------------------------------------- keywords


def cluster_keywords(spark, sf_dir):
    messages = derived.cleaned_documents(spark, sf_dir)
    return keywords.top_keywords(messages).select("label", "place", "term")


def keyword_weights(spark, sf_dir):
    messages = derived.cleaned_documents(spark, sf_dir)
    return keywords.tfidf_weights(messages).select(
        "label", "term", _six(c("weight")).alias("weight")
    )


def single_doc_words(spark, sf_dir):
    """Every document as a cluster of its own."""
    lone = derived.cleaned_documents(spark, sf_dir).withColumn("label", c("seq"))
    return keywords.top_keywords(lone).select(c("label").alias("doc_id"), "place", "term")


# --------------------------------------------------------------------- snippets


def _flagged(spark, sf_dir):
    return derived.valid_log(spark, sf_dir).select(
        "seq", "input_text", F.posexplode("response_jsonl").alias("det_pos", "det")
    ).withColumn("hits", snippets.entity_hits("input_text", c("det.sensitive_entities")))


def entity_windows(spark, sf_dir):
    windows = _flagged(spark, sf_dir).withColumn(
        "windows", snippets.context_windows(c("input_text"), c("hits"))
    )
    return windows.select(
        "seq", "det_pos", F.explode(F.array_distinct("windows")).alias("w")
    ).select("seq", "det_pos", "w.s", "w.e")


def merged_windows(spark, sf_dir):
    merged = snippets.merge_windows(snippets.context_windows(c("input_text"), c("hits")))
    return _flagged(spark, sf_dir).select(
        "seq", "det_pos", F.posexplode(merged).alias("place", "w")
    ).select("seq", "det_pos", "place", "w.s", "w.e")


def snippet_texts(spark, sf_dir):
    shown = snippets.snippet(c("input_text"), c("hits"))
    return _flagged(spark, sf_dir).select(
        "seq", "det_pos", F.length(shown).alias("shown_chars"), F.md5(shown).alias("shown_md5")
    )


def category_payloads(spark, sf_dir):
    return _payload_rows(payloads.category_payloads(derived.valid_log(spark, sf_dir)))


def payload_roundtrip(spark, sf_dir):
    """The category payloads written as JSON, as a run without a judge leaves them, and read back."""
    found = payloads.category_payloads(derived.valid_log(spark, sf_dir))
    path = f"{shared_folder(spark)}/logveil/payloads_{uuid4().hex}"
    writers.write_payloads(found, path)
    return _payload_rows(spark.read.schema(found.schema).json(path))


def judge_requests(spark, sf_dir):
    """A request per document; a missing value fills its mark with nothing."""
    text = judging.request_text(
        "Judge {category} in {lang}: {payload}",
        F.struct("doc_id", "n_chars"),
        category=c("source"),
        lang=F.nullif("lang", F.lit("fr")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("request"))


def _payload_rows(found):
    keys = ["tenant_id", "category", "dominant_detection_type", "total_detections", "samples_shown"]
    e = c("example")
    return _flat(found, "examples", "example", *keys).select(
        *keys,
        "place",
        e["heuristic_fp_score"].alias("score"),
        e["input_was_truncated"].alias("truncated"),
        e["full_detection"]["id"].alias("id"),
        e["full_detection"]["detection_type"].alias("detection_type"),
        F.size(e["full_detection"]["sensitive_entities_positive_examples"]).alias("n_entities"),
        F.size(e["full_detection"]["entity_texts_with_subcategories"]).alias("n_subtypes"),
    )


def cluster_payloads(spark, sf_dir):
    """Payloads of documents by source, with hashed vectors deciding the representatives."""
    messages = derived.cleaned_documents(spark, sf_dir)
    points = embedding.hashed_vectors(messages).select("tenant_id", "seq", "label", "vec")
    built = payloads.cluster_payloads(messages.drop("label"), stage(points, "points"))
    return built.select(
        "cluster_id",
        "message_count",
        c("date_range.from").alias("date_from"),
        c("date_range.to").alias("date_to"),
        F.size("top_keywords").alias("n_keywords"),
        F.size("representative_messages").alias("n_representatives"),
    )


# ---------------------------------------------------------------------- judging


def verdict_tallies(spark, sf_dir):
    return derived.judged_categories(spark, sf_dir).select(
        "tenant_id",
        "category",
        "estimated_fp_count_in_sample",
        "estimated_tp_count_in_sample",
        "n_uncertain",
        _six(c("estimated_fp_rate")).alias("estimated_fp_rate"),
        _six(c("fp_rate_confidence")).alias("fp_rate_confidence"),
        "overall_assessment",
        "total_detections_in_period",
        "estimated_fp_count_total",
        "estimated_tp_count_total",
    )


def quota_refill(spark, sf_dir):
    """The three first categories per tenant, by suspicion, that have a decided verdict."""
    valid = derived.valid_log(spark, sf_dir)
    ranked = false_positives.ranked_payloads(payloads.category_payloads(valid)).drop("examples")
    run = false_positives.stored_categories(valid, verdicts(spark, sf_dir))
    judged = judge.ask_with_quota(
        stage(ranked, "ranked"),
        3,
        lambda rows: run(rows).withColumn("ok", c("ok") & (c("fp_rate_confidence") > 0.3)),
    )
    return judge.first_successes(judged, 3).select(
        "tenant_id", "category", "rank", "overall_assessment"
    )


def _late_judge(batches):
    """Needs one attempt more for every letter of the category, modulo four."""
    for batch in batches:
        replies = [
            "{}" if attempt > len(category) % 4 else "not yet"
            for category, attempt in zip(batch["category"], batch["attempt"])
        ]
        yield batch[["tenant_id", "category"]].assign(reply=replies, finish_reason="stop")


def judge_attempts(spark, sf_dir):
    """Attempts it takes until each category has a readable verdict."""
    asked = payloads.category_payloads(derived.valid_log(spark, sf_dir)).select(
        *detections.CATEGORY, judging.request_text("{payload}", F.struct("examples")).alias("request")
    )
    keys = detections.CATEGORY
    _, log = judge.ask(stage(asked, "requests"), keys, _late_judge, CATEGORY_VERDICT, 3500)
    return log.groupBy(*keys).agg(
        F.max("attempt").alias("attempts"), F.bool_or(c("outcome") == "ok").alias("judged")
    )


def audit_trail(spark, sf_dir):
    """All events of a run appended to its trail and read back: both ends, calls, clusters, categories."""
    trail = Audit(f"{shared_folder(spark)}/logveil/audit_{uuid4().hex}", FIXED_RUN)
    counts = stage(reports.message_counts(landed_log(spark, sf_dir)), "counts")
    built = stage(payloads.category_payloads(derived.valid_log(spark, sf_dir)), "payloads")
    keys, shown = detections.CATEGORY, F.struct("category", "total_detections")
    requests = stage(built.select(*keys, judging.request_text("{payload}", shown).alias("request")), "requests")
    trail.run_start(counts, "fp", 7)
    _, calls = judge.ask(requests, keys, _late_judge, CATEGORY_VERDICT, 3500)
    trail.judge_calls(calls, requests, keys, "fp")
    trail.categories(built)
    labels = derived.cleaned_documents(spark, sf_dir).select("tenant_id", "seq", "label")
    shapes = clustering.cluster_sizes(labels).select(
        "*",
        F.array(F.concat(F.lit("k"), c("cluster_id"))).alias("top_keywords"),
        F.array(F.lit("text")).alias("representative_messages"),
    )
    trail.clusters(shapes, labels, "given")
    trail.run_end(fp_outcomes(counts, derived.judged_categories(spark, sf_dir)), "fp")
    asked = F.concat_ws(" ", c("request"), c("reply"), c("parsed"))
    return spark.read.json(trail.path).select(
        "event",
        "tenant_id",
        F.coalesce("category", "cluster_id", "algorithm", "mode").alias("name"),
        F.coalesce(
            "total_detections", "message_count", "n_messages", "total_records", "categories_analyzed", "attempt"
        ).alias("n"),
        F.coalesce(
            "dominant_type", c("keywords")[0], F.size("label_counts").cast("string"), c("detected_count").cast("string"),
            "status", "outcome",
        ).alias("note"),
        F.coalesce("samples_shown", "max_judged", "high_fp", "n_noise", F.when(c("latency_ms") >= 0, 1)).alias("more"),
        F.when(c("event") == "llm_call", F.md5(asked)).alias("asked"),
        "mean_fp_prior",
    )


def action_required(spark, sf_dir):
    return reports.actions(derived.judged_categories(spark, sf_dir)).select(
        "tenant_id",
        "rank",
        "category",
        "detection_type",
        "assessment",
        _six(c("estimated_fp_rate")).alias("estimated_fp_rate"),
        "total_detections",
        "estimated_fp_total",
        "estimated_tp_total",
        "tuning_recommendation",
        "mean_heuristic_fp_prior",
    )


def fp_summary(spark, sf_dir):
    return reports.fp_summary(
        landed_log(spark, sf_dir), derived.judged_categories(spark, sf_dir)
    )


def suggestions(spark, sf_dir):
    return reports.suggestions(derived.judged_clusters(spark, sf_dir)).select(
        "tenant_id",
        "rank",
        "cluster_id",
        "intent_name",
        "intent_category",
        "risk_level",
        "confidence",
        "message_count_in_cluster",
        F.array_join("top_keywords", ",").alias("keywords"),
        c("date_range.from").alias("date_from"),
    )


def sensitive_rate(spark, sf_dir):
    rate = reports.sensitive_rate(derived.judged_clusters(spark, sf_dir))
    return rate.withColumn("sensitive_rate", _six(c("sensitive_rate")))


def cluster_order(spark, sf_dir):
    ranked = intent.ranked_clusters(derived.judged_clusters(spark, sf_dir))
    return ranked.select("tenant_id", "cluster_id", "message_count", "rank")


def cluster_conformance(spark, sf_dir):
    broken = judging.cluster_violations()
    return derived.judged_clusters(spark, sf_dir).select(
        "tenant_id", "cluster_id", F.explode(broken).alias("rule")
    )


def category_conformance(spark, sf_dir):
    """Rules broken when every category were advised to tighten its pattern."""
    results = (
        derived.judged_categories(spark, sf_dir)
        .withColumn("tuning_recommendation", F.lit("tighten_regex"))
        .withColumn("overall_assessment", F.lit("moderate_fp"))
        .withColumn("risk_of_disabling", F.lit("unclear"))
        .withColumn(
            "per_example_verdicts",
            F.array(F.struct(F.when(c("n_uncertain") > 0, "MAYBE").otherwise("FP").alias("verdict"))),
        )
    )
    return results.select(
        "tenant_id", "category", F.explode(judging.category_violations()).alias("rule")
    )


# --------------------------------------------------------------------- explorer


def explorer_overview(spark, sf_dir):
    return explorer.overview(reports.message_counts(landed_log(spark, sf_dir)))


def explorer_value_counts(spark, sf_dir):
    results, clusters = derived.judged_categories(spark, sf_dir), derived.judged_clusters(spark, sf_dir)
    parts = [
        explorer.value_counts(rows, name).withColumn("field", F.lit(name))
        for rows, name in (
            (results, "overall_assessment"),
            (results, "tuning_recommendation"),
            (clusters, "risk_level"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def explorer_suggestions(spark, sf_dir):
    found = explorer.suggestion_list(
        reports.suggestions(derived.judged_clusters(spark, sf_dir)),
        risks=("critical", "high", "medium"),
        min_confidence=0.4,
        search="SOURCE 1",
    )
    return found.select("tenant_id", "rank", "intent_name", "risk_level", "confidence")


def explorer_cards(spark, sf_dir):
    cards = explorer.suggestion_card(reports.suggestions(derived.judged_clusters(spark, sf_dir)))
    return _flat(cards, "evidence", "evidence", "tenant_id", "rank", "first_day", "last_day")


def explorer_clusters(spark, sf_dir):
    return explorer.cluster_table(derived.judged_clusters(spark, sf_dir))


def explorer_scatter(spark, sf_dir):
    found = explorer.rate_scatter(derived.judged_categories(spark, sf_dir))
    return found.withColumn("fp_rate", _six(c("fp_rate"))).withColumn(
        "confidence", _six(c("confidence"))
    )


def explorer_actions(spark, sf_dir):
    risk = F.when(c("n_uncertain") > 0, F.lit("medium"))
    judged = derived.judged_categories(spark, sf_dir).withColumn("risk_of_disabling", risk)
    return explorer.action_list(
        reports.actions(judged), tunings=("tighten_regex", "reduce_scope"), search="e"
    )


def explorer_drilldown(spark, sf_dir):
    ranked = reports.ranked_categories(derived.judged_categories(spark, sf_dir))
    return explorer.drilldown(ranked, "License Notice").select(
        "tenant_id",
        "rank",
        "category",
        "overall_assessment",
        "estimated_fp_count_in_sample",
        "estimated_tp_count_in_sample",
        "n_uncertain",
    )


def explorer_categories(spark, sf_dir):
    return explorer.category_table(derived.judged_categories(spark, sf_dir))


def explorer_options(spark, sf_dir):
    """The categories to choose from with their place, and the first example verdict of each."""
    results = derived.judged_categories(spark, sf_dir)
    options = explorer.category_options(results).withColumnRenamed("place", "option")
    shown = explorer.verdict_table(derived.with_examples(spark, sf_dir, results))
    return options.join(shown, ["tenant_id", "category"])


# -------------------------------------------------------------- sources and runs


def window_read(spark, sf_dir):
    start, end = readers.window_bounds(datetime(2024, 1, 1, 10, 0), lookback_hours=8)
    found = readers.read_window(landed_log(spark, sf_dir), start, end)
    return found.select("tenant_id", "seq", "created_at")


def envelope_unwrap(spark, sf_dir):
    from pyspark.sql.types import StructType

    found = readers.unwrap(
        derived.envelopes(spark, sf_dir), "payload", StructType.fromDDL(derived.EVENT_SCHEMA)
    )
    return found.select("payload_id", "pos", "record.*")


def tenant_preflight(spark, sf_dir):
    """Users of the event log without a large error, as tenants nobody knows."""
    events = table(spark, sf_dir, "events").select(
        c("user_id").cast("string").alias("tenant_id"), "event_type", "value"
    )
    return readers.check_tenants(events, events.where("event_type = 'error' and value > 50"))


def coverage_audit(spark, sf_dir):
    found = ledger.window_coverage(derived.run_ledger(spark, sf_dir))
    return found.select(
        "mode", "run_id", _six(c("gap_hours")).alias("gap_hours"),
        _six(c("overlap_hours")).alias("overlap_hours"), "coverage",
    )


def next_due(spark, sf_dir):
    found = ledger.next_due(derived.run_ledger(spark, sf_dir), FIXED_RUN)
    return found.select("mode", F.round("seconds_left", 3).alias("seconds_left"))


def last_run(spark, sf_dir):
    found = ledger.last_success(derived.run_ledger(spark, sf_dir))
    return found.select(F.unix_micros("last_run").alias("last_run_micros"))


def array_log(spark, sf_dir):
    """The log written as JSON arrays with some broken members, and what is read back."""
    broken = F.when(c("errors").isNotNull(), F.lit('{"input_text": oops}'))
    rows = landed_log(spark, sf_dir).select(
        F.floor(c("seq") / 256).alias("chunk"),
        "seq",
        F.coalesce(broken, F.to_json(F.struct("tenant_id", "created_at", "input_text", "response_jsonl"))).alias("member"),
    )
    files = rows.groupBy("chunk").agg(
        F.concat(
            F.lit("["),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "member"))), lambda m: m["member"]), ",\n"),
            F.lit("]"),
        ).alias("value")
    )
    path = f"{shared_folder(spark)}/logveil/array_log_{uuid4().hex}"
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = readers.read_array_log(spark, path)
    return filters.valid_records(back).select(
        "tenant_id",
        "created_at",
        F.md5("input_text").alias("text_md5"),
        F.size("response_jsonl").alias("detections"),
    )


def stream_intake(spark, sf_dir):
    """The log landed as JSON lines and taken in by the stream."""
    path = f"{shared_folder(spark)}/logveil/intake_{uuid4().hex}"
    landed_log(spark, sf_dir).drop("event_ts").write.json(f"{path}/landing")
    ingest(spark, f"{path}/landing", f"{path}/log", f"{path}/state").awaitTermination()
    back = readers.read_table_log(spark, f"{path}/log")
    return back.groupBy("tenant_id", c("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("input_text")).alias("characters")
    )


def report_roundtrip(spark, sf_dir):
    """The false-positive report written as documents and read back."""
    results = derived.judged_categories(spark, sf_dir)
    report = reports.fp_report(landed_log(spark, sf_dir), stage(results, "results"))
    folder = f"{shared_folder(spark)}/logveil/report_{uuid4().hex}"
    path = writers.write_report(
        report.summary, {"action_required": report.actions}, folder, "fp", FIXED_RUN
    )
    back = writers.report_rows(writers.read_report(spark, path), "action_required")
    return back.select("tenant_id", "rank", "category", "assessment", "total_detections")


def saved_runs(spark, sf_dir):
    """Both reports saved as one run, after a try that failed half way and one that is replaced, and read back."""
    store = RunStore(f"{shared_folder(spark)}/logveil/store_{uuid4().hex}")
    log = landed_log(spark, sf_dir)
    found = stage(derived.judged_categories(spark, sf_dir), "results")
    fp = reports.fp_report(log, found)
    clusters = reports.suggestions(stage(derived.judged_clusters(spark, sf_dir), "results"))
    start, end = readers.window_bounds(FIXED_RUN)
    store.begin("r1").write_report("fp", fp.summary, {"action_required": fp.actions}, FIXED_RUN)  # never committed
    for run, hours, rows in (("r1", 1, fp.actions.limit(0)), ("r1", 2, fp.actions)):
        attempt = store.begin(run)
        attempt.write_report("fp", fp.summary, {"action_required": rows}, FIXED_RUN)
        attempt.write_report("intent", fp.summary, {"suggestions": clusters}, FIXED_RUN)
        attempt.commit(spark, start, end, end + timedelta(hours=hours), [("intent", "ok", None), ("fp", "ok", None)])
    fields = "suggestions array<struct<rank:int,cluster_id:string,intent_name:string,message_count_in_cluster:bigint>>"
    nested = store.read(spark, "intent_documents").select("run_id", "tenant_id", F.from_json("document", fields).alias("d"))
    suggested = nested.select("run_id", "tenant_id", F.inline("d.suggestions")).select(
        "run_id", F.lit("intent").alias("mode"), "tenant_id", "rank", "cluster_id",
        c("intent_name").alias("name"), c("message_count_in_cluster").alias("n"),
    )
    tuned = store.read(spark, "fp_action_required").select(
        "run_id", F.lit("fp").alias("mode"), "tenant_id", "rank", F.lit(None).cast("string").alias("cluster_id"),
        c("category").alias("name"), c("total_detections").alias("n"),
    )
    runs = store.ledger(spark).select("run_id", "mode", _micros(c("finished_ts")).alias("finished"))
    return suggested.unionByName(tuned).join(runs, ["run_id", "mode"])


def intent_job(spark, sf_dir):
    """The whole intent analysis up to ranked suggestions, with a stored verdict per cluster."""
    log = landed_log(spark, sf_dir)
    run = intent.run_intent(log)
    known = run.payloads.select(
        "tenant_id",
        "cluster_id",
        (c("label") >= 0).alias("is_sensitive"),
        F.least(F.lit(1.0), c("message_count") / 10).alias("sensitivity_confidence"),
        *[
            F.lit(None).cast("string").alias(n)
            for n in (
                "confidence_rationale",
                "intent_name",
                "detected_intent_category",
                "intent_description",
                "suggested_dlp_model",
                "suggested_model_rationale",
                "risk_level",
                "risk_rationale",
            )
        ],
        *[
            F.array().cast("array<string>").alias(n)
            for n in (
                "evidence_messages",
                "example_triggering_phrases",
                "example_counter_phrases",
            )
        ],
    )
    judged = judge.ask_with_quota(
        intent.ranked_clusters(run.payloads), 10, intent.stored_clusters(known)
    )
    report = reports.intent_report(
        log, filters.valid_records(log), run.cleaned, judged.where("ok").drop("ok")
    )
    return report.suggestions.select(
        "tenant_id", "rank", "cluster_id", "message_count_in_cluster", "confidence",
        F.array_join("top_keywords", ",").alias("keywords"),
    )


def fp_job(spark, sf_dir):
    """The whole false-positive analysis with the stored verdicts as judge."""
    log = landed_log(spark, sf_dir)
    settings = Settings()
    valid = filters.valid_records(log)
    run = false_positives.run_false_positives(
        log, false_positives.stored_categories(valid, verdicts(spark, sf_dir), settings)
    )
    return run.report.actions.select("tenant_id", "rank", "category", "assessment")


QUERIES = {
    f.__name__: f
    for f in (
        suspicious_topn, message_split, split_and_union, existing_detections, detection_rows,
        category_profile, detection_rate_72h, normalized_tokens, shingle_sets, turn_overlap,
        head_tail, json_in_text, dedup_jaccard, dedup_minhash, burst_first_wins, funnel, run_status,
        unit_vectors, eps_edges, dbscan_labels, cluster_sizes, cluster_summary, centroids,
        representatives, cluster_dates, hashed_embedding, reduced_embedding, cluster_keywords,
        keyword_weights, single_doc_words, entity_windows, merged_windows, snippet_texts,
        category_payloads, payload_roundtrip, judge_requests, cluster_payloads, verdict_tallies, judge_attempts, audit_trail, quota_refill, action_required,
        fp_summary, suggestions, sensitive_rate, cluster_order, cluster_conformance,
        category_conformance, explorer_overview, explorer_value_counts, explorer_suggestions,
        explorer_cards, explorer_clusters, explorer_scatter, explorer_actions, explorer_drilldown,
        explorer_categories, explorer_options, window_read, envelope_unwrap, tenant_preflight, coverage_audit,
        next_due, last_run, array_log, stream_intake, report_roundtrip, saved_runs, intent_job, fp_job,
    )
}
