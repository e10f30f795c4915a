"""Line deduplication by overlapping three-line windows, in DataFrame functions only.

A text's lines are its parts between newlines, unchanged and blank ones included. Each three
consecutive lines form a window; windows overlap. A window whose lines also occur earlier (in a
document with a smaller id, or further up in the same one) is a repeat, and the lines it covers
go. Windows are judged on the input. Three blank lines (white space only) are no window.

Plan: window hashes (128 bits) per document are exploded as narrow rows; a grouped minimum with
partial sums finds the earliest place of each repeated one, and that table is written first, so
that the join back is either a broadcast of known size or a sort-merge join of two plain
exchanges, whose hot keys adaptive execution splits. Covered places are merged to
spans per document with a running window, and the lines between the spans are sliced out, so a
text with very many lines costs time in proportion to them.

Defined cases: a null text has no lines and stays null; texts of one or two lines have no window;
an empty table gives an empty result; rows that share a doc_id each lose what any of them
loses; a null doc_id comes before all others. All columns of the input are kept, whatever their names;
columns called n_lines and n_removed_lines are replaced by this operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.llm.rows import packed
from logveil.scratch import stage

SIZE = 3
ADDED = ("n_lines", "n_removed_lines")
_KEY = "__line_key"


def window_rows(documents: DataFrame) -> DataFrame:
    """(key, at, h1, h2): the place and hash of every window; `at` counts lines from 1."""
    lines = documents.select(_KEY, F.split("text", "\n", -1).alias("l")).where(F.size("l") >= SIZE)
    three = lambda i: [F.col("l")[i + k - 1] for k in range(SIZE)]
    hashed = lambda i: F.struct(
        i.cast("int").alias("at"),
        F.xxhash64(*three(i)).alias("h1"),
        F.xxhash64(F.lit(SIZE), *three(i)).alias("h2"),
        F.concat(*three(i)).rlike(r"[^\x20\x09-\x0D]").alias("full"),
    )
    each = lines.select(
        _KEY, F.explode(F.transform(F.sequence(F.lit(1), F.size("l") - (SIZE - 1)), hashed)).alias("w")
    )
    return each.where("w.full").select(_KEY, "w.at", "w.h1", "w.h2")


def spans(later: DataFrame) -> DataFrame:
    """(key, spans): the windows at the given places merged to ascending, disjoint line ranges."""
    by_doc = Window.partitionBy(_KEY).orderBy("at")
    gap = F.coalesce(F.col("at") - F.lag("at").over(by_doc) > SIZE, F.lit(False))
    return (
        later.select(_KEY, "at")
        .distinct()
        .withColumn("apart", gap)
        .withColumn("island", F.sum(F.col("apart").cast("int")).over(by_doc))
        .groupBy(_KEY, "island")
        .agg(F.min("at").alias("a"), (F.max("at") + (SIZE - 1)).alias("b"))
        .groupBy(_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    )


def _between(lines, found):
    """The lines outside the spans: before the first, between neighbours, and after the last."""
    n = F.size(found)
    begin = lambda i: F.when(i == 0, 1).otherwise(F.get(found, i - 1)["b"] + 1)
    end = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(found, i)["a"] - 1)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), n),
            lambda i: F.slice(lines, begin(i), F.greatest(end(i) - begin(i) + 1, F.lit(0))),
        )
    )


def remove_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents with `text` shortened, and n_lines and n_removed_lines added."""
    lowest = F.lit(-(1 << 63)).cast("long")
    key, text = F.coalesce(F.col("doc_id").cast("long"), lowest).alias(_KEY), F.col("text").cast("string").alias("text")
    keyed = documents.select(key, text, packed(documents, ADDED))
    rows = window_rows(keyed.select(_KEY, "text"))
    repeated = stage(
        rows.groupBy("h1", "h2")
        .agg(F.min(F.struct(_KEY, "at")).alias("e"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h1", "h2", "e"),
        "windows",
    )
    later = rows.join(repeated, ["h1", "h2"]).where(F.struct(_KEY, "at") > F.col("e"))
    out = keyed.join(spans(later), _KEY, "left")
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(
        F.array_join(_between(lines, F.col("spans")), "\n")
    )
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"] + 1)
    return out.select(
        *[kept.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns if c not in ADDED],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0).cast("long")).alias("n_removed_lines"),
    )
