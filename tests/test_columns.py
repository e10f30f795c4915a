"""Columns with hand-computed values."""

import pytest
from pyspark.sql import functions as F

from logveil.functions import detections as det
from logveil.functions import judging, text, vectors


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_whitespace_and_tokens(spark):
    rows = [("  a \t b\n",), ("",), ("a b c\x1cd",), (None,)]
    assert values(spark, text.normalize_space(F.col("t")), rows, "t string") == ["a b", "", "a b c d", None]
    assert values(spark, text.token_count(F.col("t")), rows, "t string") == [2, 0, 4, 0]


def test_shingles_and_overlap(spark):
    rows = [("a B c d",), ("a b",), ("",), ("x x x x",)]
    got = values(spark, text.word_shingles(F.col("t")), rows, "t string")
    assert [set(g) for g in got] == [{"a b c", "b c d"}, set(), set(), {"x x x"}]
    hashed = values(spark, F.size(text.shingle_hashes(F.col("t"))), rows, "t string")
    assert hashed == [2, 0, 0, 1]
    pairs = [(["a", "b"], ["b", "c"]), ([], ["a"]), (["a"], ["a"])]
    got = values(spark, text.jaccard(F.col("a"), F.col("b")), pairs, "a array<string>, b array<string>")
    assert got == pytest.approx([1 / 3, 0.0, 1.0])


def test_head_tail(spark):
    rows = [("x" * 1200,), ("a" * 600 + "b" * 601,)]
    got = values(spark, text.head_tail(F.col("t")), rows, "t string")
    assert got[0] == "x" * 1200
    assert got[1] == "a" * 585 + "\n…[middle truncated]…\n" + "b" * 585
    assert values(spark, text.was_truncated(F.col("t")), rows, "t string") == [False, True]


def test_percent_and_search(spark):
    rows = [(1, 3), (0, 0), (5, 8)]
    assert values(spark, text.percent(F.col("a"), F.col("b")), rows, "a int, b int") == ["33.3%", "—", "62.5%"]
    rows = [("Salary Bands", ["pay"]), ("x", ["PayRoll"]), ("x", None)]
    got = values(spark, text.matches_any("payroll", F.col("n"), words=F.col("k")), rows, "n string, k array<string>")
    assert got == [False, True, False]


def test_detector_kind_and_category(spark):
    rows = [(k,) for k in ("pattern", " PATTERN", "ml", "Semantic", "edm", "other", None)]
    assert values(spark, det.detector_kind(F.col("k")), rows, "k string") == [
        "pattern", "pattern", "contextual", "contextual", "edm", "unknown", "unknown",
    ]
    rows = [("a", "b"), ("", "b"), (None, ""), (None, None)]
    got = values(spark, det.category_name(F.col("n"), F.col("m")), rows, "n string, m string")
    assert got == ["a", "b", "Unknown", "Unknown"]


SCORES = [
    ("pattern", {"asha@okaxis": "UPI ID"}, 5, ["asha@okaxis"], 1.0),
    ("contextual", {"bob@mail.com": "UPI ID"}, 30, ["bob@mail.com"], 0.55),
    ("contextual", {"x@corp": "EMAIL"}, 30, ["x@corp"], 0.4),
    ("edm", {}, 5, ["a", "a", "a", "b"], 0.5),
    ("edm", {}, 30, ["a", "a", "b"], 0.2),
    ("pattern", None, 20, None, 0.6),
]


def test_suspicion_score(spark):
    rows = [s[:4] for s in SCORES]
    schema = "k string, m map<string,string>, n int, e array<string>"
    got = values(
        spark, det.suspicion_score(F.col("k"), F.col("n"), F.col("e"), F.col("m")), rows, schema
    )
    assert got == [s[4] for s in SCORES]


def test_json_in_text(spark):
    rows = [('ok {"a":1} bye',), ('```json\n{"a": 2}\n```',), ("none",), ('{"a":',), ("```\n[1]\n```",)]
    got = values(spark, judging.json_in_text(F.col("r")), rows, "r string")
    assert got == ['{"a":1}', '{"a": 2}', None, None, "[1]"]


def test_json_with_repeated_names_or_broken_ends(spark):
    rows = [('x {"a":1,"a":2}',), ('{"a":1} and {"b":2}',), ('{"a":1}, {"b":2}',), ('{"a":1}] b}',), ('{"a":1}} b}',), ("",), (None,)]
    got = values(spark, judging.json_in_text(F.col("r")), rows, "r string")
    assert got == ['{"a":1,"a":2}', *[None] * 6]
    read = F.from_json(judging.json_in_text(F.col("r")), "a int")["a"]
    assert values(spark, read, rows[:1], "r string") == [2]


def test_rates_and_counts(spark):
    rows = [(2, 1), (0, 0)]
    got = values(spark, judging.rate_from_tally(F.col("f"), F.col("t")), rows, "f int, t int")
    assert got == pytest.approx([2 / 3, 0.5])
    rows = [(x,) for x in (0.6, 0.61, 0.3, 0.1, 0.09)]
    assert values(spark, judging.assessment(F.col("r")), rows, "r double") == [
        "moderate_fp", "high_fp", "moderate_fp", "low_fp", "no_fp",
    ]
    rows = [(0.5, 5), (None, 4), (0.5, 3)]
    got = values(spark, judging.extrapolated_fp(F.col("r"), F.col("n")), rows, "r double, n bigint")
    assert got == [2, 0, 2]


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])]
    schema = "a array<float>, b array<float>"
    assert values(spark, vectors.unit(F.col("a")), rows, schema) == [[0.6, 0.8], [0.0, 0.0]]
    got = values(spark, vectors.cosine_distance(F.col("a"), F.col("b")), rows, schema)
    assert got == pytest.approx([1 - 24 / 25, 1.0])
