"""Near-duplicate sets are only sent for pairs that pass the bounds; patterns only run where they can match."""

import re

from logveil.given import records
from logveil.operators import dedup


def test_only_the_sets_of_pairs_are_sent(spark, monkeypatch):
    written, stage = [], dedup.stage

    def counted(df, label, *more):
        out = stage(df, label, *more)
        if "tokens" in out.columns and label != "sets":
            written.append(out.count())
        return out

    monkeypatch.setattr(dedup, "stage", counted)
    # all share one passage, but their lengths are too far apart for any to be similar; the last two are
    texts = ["one shared passage of six words " + " ".join(f"t{i}x{k}" for k in range(8 * 3**i)) for i in range(5)]
    texts += [" ".join(f"n{k}" for k in range(60)), " ".join(f"n{k}" for k in range(61))]
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "tenant_id string, seq bigint, clean_text string")
    assert [r["seq"] for r in dedup.jaccard_duplicates(rows, 0.5).collect()] == [6]
    assert 2 <= sum(written) <= 4


def test_every_match_of_a_detector_holds_its_mark(spark):
    texts = ["1.22.3.4", "+1 (212) 555-0199", "a@b", 'token = "' + "0f" * 20 + '"', "a licence", "A License", "1234567812345678", "none", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    found = rows.select("text", *[records._hits(n, p).alias(n) for n, _, p in records.DETECTORS]).collect()
    for r in found:
        for name, _, pattern in records.DETECTORS:
            assert (r[name] or []) == [m.group(0) for m in re.finditer(pattern, r["text"] or "")]
    assert all(sum(bool(r[n]) for n, _, _ in records.DETECTORS) == 1 for r in found[:7])
