"""Windows against the mask of characters they cover, snippets by hand and by what must hold."""

import random
import re

from pyspark.sql import functions as F

from logveil.functions import snippets


def run(spark, rows, width, limit):
    df = spark.createDataFrame(rows, "i int, t string, e array<string>")
    df = df.withColumn("h", snippets.entity_hits("t", "e"))
    merged = snippets.merge_windows(snippets.context_windows(F.col("t"), F.col("h"), width))
    out = df.select("i", merged.alias("m"), snippets.snippet(F.col("t"), F.col("h"), width, limit).alias("s"))
    return {r["i"]: ([(w["s"], w["e"]) for w in r["m"]], r["s"]) for r in out.collect()}


def runs_of_covered_characters(t, entities, width):
    """Each character near a hit is marked; the windows are the runs of marks."""
    marks = [False] * len(t)
    for e in filter(None, entities):
        wanted = re.escape(e.strip().lower())
        for hit in re.finditer(f"(?={wanted})", t.lower()) if wanted else ():
            for i in range(hit.start() - width, hit.start() + len(e) + width):
                if 0 <= i < len(t):
                    marks[i] = True
    return [m.span() for m in re.finditer("1+", "".join("01"[m] for m in marks))]


def test_by_hand(spark):
    t = "0123456789XY0123456789xy0123456789"
    assert run(spark, [(0, t, ["xy"])], 3, 1200)[0] == ([(7, 15), (19, 27)], "…789XY012…\n---\n…789xy012…")
    assert run(spark, [(0, t, ["xy"])], 5, 1200)[0][0] == [(5, 29)]
    got = run(spark, [(0, "aaaa", ["aa"]), (1, "none", ["  ", "", None])], 0, 1200)
    assert got == {0: ([(0, 4)], "aaaa"), 1: ([], "none")}


def random_rows():
    rng = random.Random(3)
    letters = lambda signs, most: "".join(rng.choice(signs) for _ in range(rng.randint(0, most)))
    return [(i, letters("abcé \n", 900), [letters("abcÉ ", 4) for _ in range(rng.randint(0, 3))]) for i in range(60)]


def test_windows_cover_what_is_near_a_hit(spark):
    for width, limit in ((3, 200), (30, 300), (300, 1200)):
        got = run(spark, random_rows(), width, limit)
        for i, t, e in random_rows():
            assert got[i][0] == runs_of_covered_characters(t, e, width), (i, width)


def test_snippets_hold_to_budget_and_order(spark):
    for width, limit in ((3, 200), (30, 300), (300, 1200)):
        for i, (windows, text) in run(spark, random_rows(), width, limit).items():
            t = random_rows()[i][1]
            if not windows:
                assert text == t if len(t) <= limit else "middle truncated" in text and len(text) < limit + 10
                continue
            parts = text.split("\n---\n")
            assert len(parts) <= len(windows) and sum(map(len, parts)) <= limit + 1  # a cut adds its mark
            assert parts[0].startswith("…") == (windows[0][0] > 0)
            for part, (s, e) in zip(parts, windows):
                inner = part.strip("…")
                assert t[s:e].startswith(inner)
                assert inner == t[s:e] or part is parts[-1]


def test_snippets_that_do_not_fit(spark):
    t = "-" * 50 + "xy" + "-" * 100 + "xy" + "-" * 50
    windows = [(30, 72), (132, 174)]
    whole = "…" + "-" * 20 + "xy" + "-" * 20 + "…"
    assert run(spark, [(0, t, ["xy"])], 20, 200)[0] == (windows, f"{whole}\n---\n{whole}")
    assert run(spark, [(0, t, ["xy"])], 20, 80)[0] == (windows, whole)  # 36 are left: too few to begin another
    wide = "…" + "-" * 40 + "xy" + "-" * 40 + "…"
    cut = run(spark, [(0, t, ["xy"])], 40, 150)[0]
    assert cut == ([(10, 92), (112, 194)], f"{wide}\n---\n{wide[:66]}…")
