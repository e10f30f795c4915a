"""Readers, sinks, the run ledger and the incremental intake."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logveil.operators import filters
from logveil.plans import runs
from logveil.plans.audit import fp_outcomes
from logveil.sources import arrays, ledger, readers, writers
from logveil.streaming.ingest import ingest


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def members(spark, tmp_path, content):
    folder = tmp_path / f"in{random.random()}"
    write(folder, "log.json", content)
    rows = readers.array_members(spark, str(folder)).orderBy("pos").collect()
    return [json.loads(r["record_json"]) for r in rows if r["ok"]], sum(not r["ok"] for r in rows)


def test_broken_arrays_are_salvaged(spark, tmp_path):
    got = members(spark, tmp_path, '[{"input_text":"a b"}, {"input_text": oops}, {"input_text":"c"}]')
    assert got == ([{"input_text": "a b"}, {"input_text": "c"}], 1)
    got = members(spark, tmp_path, '[{"a": "}{"}, {"b": {"c": "\\"}"}}, } {"d": 1}, {"e": ]')
    assert got == ([{"a": "}{"}, {"b": {"c": '"}'}}, {"d": 1}], 0)
    with pytest.raises(Exception, match="expected a JSON array"):
        members(spark, tmp_path, '{"input_text": "a"}')


def test_encodings(spark, tmp_path):
    assert members(spark, tmp_path, b'\xef\xbb\xbf[{"t": "\xc3\xa9"}]') == ([{"t": "é"}], 0)
    got, skipped = members(spark, tmp_path, b'[{"t": "a\xffb"}]')
    assert got == [{"t": "a�b"}] and skipped == 0


@pytest.fixture
def tiny_splits(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ["90", "1"]):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def arrays_of_all_kinds():
    """Sound and broken arrays whose strings are full of marks; splits fall everywhere."""
    rng = random.Random(12)
    parts = ["}", "{", "]", "[", ",", '"', "'", "\\", "\n", "é", "x", "it's", "中"]

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 4)
        if kind < 3:
            return "".join(rng.choices(parts, k=rng.randint(0, 12)))
        if kind == 3:
            return rng.choice([1, -2.5, None, True])
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {f"k{i}": value(depth + 1) for i in range(rng.randint(0, 3))}

    out = ["[]", " [ ] \n", "[1, \"a\", [2, {}], null]", "\n\t[{}]", '[{"a": 1}', '[{"a": 1}]x', "[{}, ]", "[{}],[{}]", "[{'a': \"}\"}, {\"b\": 1}]"]
    for _ in range(14):
        sound = json.dumps([value() for _ in range(rng.randint(1, 9))], ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        out.append(sound)
        at = rng.randrange(1, len(sound))
        out.append(sound[:at] + rng.choice(parts) + sound[at:])
        out.append("[" + sound[1:at] + sound[at + 1 :])
    return out


def test_split_arrays_equal_whole_ones(spark, tmp_path, tiny_splits, monkeypatch):
    monkeypatch.setattr(readers, "WHOLE", 0)
    texts, expected = arrays_of_all_kinds(), {}
    for number, text in enumerate(texts):
        try:
            expected[number] = [(json.loads(m) if ok else None, ok) for m, ok in readers._array_members(text)]
        except ValueError:
            with pytest.raises(Exception, match="no array in file"):
                write(tmp_path / f"bad{number}", "log.json", text)
                readers.array_members(spark, str(tmp_path / f"bad{number}")).collect()
            continue
        write(tmp_path / "in", f"{number}.json", text)
    found = {number: [] for number in expected}
    for r in readers.array_members(spark, str(tmp_path / "in")).orderBy("file", "pos").collect():
        found[int(r["file"].rsplit("/", 1)[1][:-5])].append((r["pos"], json.loads(r["record_json"]) if r["ok"] else None, r["ok"]))
    for number, rows in expected.items():
        assert found[number] == [(pos, *row) for pos, row in enumerate(rows)], texts[number]


def test_one_large_array_is_read_by_all_cores(spark, tmp_path):
    filler = "x}{\"'" * 40
    member = json.dumps({"input_text": filler, "response_jsonl": [{"name": "a"}]})
    n = 150_000
    (tmp_path / "big").mkdir()
    with open(tmp_path / "big" / "log.json", "w") as f:
        f.write("[" + ",".join([member] * (n - 1)) + ', {"input_text": oops}]')
    assert (tmp_path / "big" / "log.json").stat().st_size > 40_000_000
    records = arrays.split_records(spark, str(tmp_path / "big"))
    tasks = records.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) >= 8 and max(t["count"] for t in tasks) < 0.2 * sum(t["count"] for t in tasks)
    figures = readers.array_members(spark, str(tmp_path / "big")).agg(
        F.count("*"), F.count_if("ok"), F.max("pos"), F.count_distinct("record_json")
    ).first()
    assert tuple(figures) == (n, n - 1, n - 1, 2)


def test_array_log_order_and_fields(spark, tmp_path):
    one = {
        "tenant_id": "t", "created_at": "2024-01-02T03:04:05", "input_text": "hi", "errors": {"x": 1},
        "response_jsonl": [{"name": "n", "sensitive_entities": ["e"], "entity_texts_with_subcategories": {"e": "s"}}],
    }
    write(tmp_path / "log", "b.json", json.dumps([one, {"input_text": "later", "errors": []}]))
    write(tmp_path / "log", "a.json", json.dumps([{"input_text": "first", "errors": False}]))
    rows = readers.read_array_log(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [r["input_text"] for r in rows] == ["first", "hi", "later"]
    assert rows[1]["errors"] == '{"x":1}' and rows[1]["event_ts"] == datetime(2024, 1, 2, 3, 4, 5)
    assert rows[1]["response_jsonl"][0]["entity_texts_with_subcategories"] == {"e": "s"}
    valid = runs.run_false_positives(runs.file_records(spark, str(tmp_path / "log"))).status
    assert {r["tenant_id"]: r["fp_status"] for r in valid.collect()} == {
        "unknown": "No detected messages found", "t": "No detected messages found",
    }


def test_window_bounds():
    now = datetime(2024, 1, 10)
    assert readers.window_bounds(now) == (now - timedelta(hours=72), now)
    assert readers.window_bounds(now, lookback_hours=5)[0] == now - timedelta(hours=5)
    assert readers.window_bounds(now, end=datetime(2024, 1, 5))[0] == datetime(2024, 1, 2)
    with pytest.raises(ValueError):
        readers.window_bounds(now, start=now, lookback_hours=5)


def test_envelopes(spark):
    rows = [(1, '{"data":[{"input_text":"x"}],"records":[{"input_text":"y"}]}'), (2, '[{"input_text":"z"}]')]
    got = readers.unwrap(spark.createDataFrame(rows, "id int, p string"), "p")
    assert {r["id"]: r["record"]["input_text"] for r in got.collect()} == {1: "y", 2: "z"}
    with pytest.raises(Exception, match="no list of records"):
        readers.unwrap(spark.createDataFrame([(1, '{"total": 1}')], "id int, p string"), "p").collect()


def test_tenants_are_required(spark):
    known = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    readers.require_tenants(known.limit(1), known)
    other = spark.createDataFrame([("z",)], "tenant_id string")
    readers.require_tenants(other, known, skip=True)
    with pytest.raises(ValueError, match="z"):
        readers.require_tenants(other, known)


def test_window_of_a_partitioned_log_prunes(spark, tmp_path):
    at = datetime(2024, 1, 5)
    log = spark.createDataFrame(
        [("t", i, at + timedelta(hours=i)) for i in range(100)], "tenant_id string, seq bigint, event_ts timestamp"
    ).withColumn("event_date", F.to_date("event_ts"))
    log.write.partitionBy("event_date").parquet(str(tmp_path / "log"))
    table = readers.read_table_log(spark, str(tmp_path / "log"))
    found = runs.window_records(table, at + timedelta(hours=99), lookback_hours=10)
    assert found.count() == 11
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_intake_takes_every_file_once(spark, tmp_path):
    landing, log, state = (str(tmp_path / n) for n in ("landing", "log", "state"))

    def land(name, first):
        lines = [
            json.dumps({"seq": i, "tenant_id": "t", "input_text": f"m{i}", "created_at": f"2024-01-0{1 + i % 3}T00:00:00"})
            for i in range(first, first + 6)
        ]
        write(tmp_path / "landing", name, "\n".join(lines))

    land("a.json", 0)
    ingest(spark, landing, log, state).awaitTermination()
    ingest(spark, landing, log, state).awaitTermination()
    land("b.json", 6)
    ingest(spark, landing, log, state).awaitTermination()
    got = readers.read_table_log(spark, log)
    assert sorted(r["seq"] for r in got.collect()) == list(range(12))


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.read_ledger(spark, path).count() == 0
    assert ledger.last_success(ledger.read_ledger(spark, path)).first()["last_run"] is None
    at = datetime(2024, 1, 1)
    hours = [(0, 72), (72, 144), (150, 222), (200, 272)]
    for i, (a, b) in enumerate(hours):
        end = at + timedelta(hours=b)
        ledger.append_run(spark, path, str(i), at + timedelta(hours=a), end, end, "both", "ok")
    ledger.append_run(spark, path, "x", at, at + timedelta(hours=900), at + timedelta(hours=900), "both", "failed")
    runs_done = ledger.read_ledger(spark, path)
    got = ledger.window_coverage(runs_done).orderBy("start_ts").collect()
    assert [(r["coverage"], r["gap_hours"], r["overlap_hours"]) for r in got] == [
        ("ok", 0, 0), ("ok", 0, 0), ("gap", 6, 0), ("overlap", 0, 22),
    ]
    due = ledger.next_due(runs_done, at + timedelta(hours=300), 72).first()
    assert due["seconds_left"] == (72 - 28) * 3600
    assert ledger.next_due(runs_done, at + timedelta(hours=400), 72).first()["seconds_left"] == 0


def test_report_documents_and_audit(spark, tmp_path):
    summary = spark.createDataFrame([("a", 3), ("b", 0)], "tenant_id string, total bigint")
    ranked = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "tenant_id string, rank int, name string")
    at = datetime(2024, 5, 6, 7, 8, 9)
    path = writers.write_report(summary, {"items": ranked}, str(tmp_path / "out"), "intent", at)
    assert path.endswith("intent_20240506_070809")
    back = writers.read_report(spark, path)
    docs = {r["tenant_id"]: r for r in back.collect()}
    assert [i["name"] for i in docs["a"]["items"]] == ["x", "y"] and docs["b"]["summary"]["total"] == 0
    assert writers.report_rows(back, "items").count() == 2
    log = str(tmp_path / "audit")
    counts = spark.createDataFrame(
        [("a", 5, 2)], "tenant_id string, total_messages long, messages_with_existing_detection long"
    )
    writers.append_audit(writers.run_started(counts, "fp", None, at), log)
    writers.append_audit(writers.run_ended(fp_outcomes(counts, None), "fp", at), log)
    events = {r["event"]: r for r in spark.read.json(log).collect()}
    assert events["run_start"]["total_records"] == 5 and events["run_end"]["status"] == "ok"


@pytest.mark.parametrize("layout", ["lines", "array"])
def test_errors_keep_their_type(spark, tmp_path, layout):
    """Empty values are no errors, strings that only spell them are; so are odd objects."""
    none = ["0.0", "0", "-0", "0e3", "false", "[]", "{}", "null", '""']
    some = ['"0"', '"false"', '"[]"', '"null"', "1", "0.5", "true", '[""]', '{"a":1,"a":2}', '"timeout"']
    objects = [f'{{"seq":{i},"input_text":"m{i}","errors":{e}}}' for i, e in enumerate(none + some)]
    if layout == "lines":
        write(tmp_path / "log", "a.json", "\n\n".join(objects) + "\n")
        rows = readers.read_lines_log(spark, str(tmp_path / "log"))
    else:
        write(tmp_path / "log", "a.json", "[" + ",".join(objects) + "]")
        rows = readers.read_array_log(spark, str(tmp_path / "log"))
    valid = {r["input_text"] for r in filters.valid_records(rows).collect()}
    assert valid == {f"m{i}" for i in range(len(none))}
