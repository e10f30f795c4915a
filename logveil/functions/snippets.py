"""Context windows around flagged entities, and the snippet made of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.functions.columns import let
from logveil.functions.text import head_tail

# How snippets are put together.
CUT_MARK = "…"
CHUNK_JOIN = "\n---\n"
MIN_LAST_CHUNK = 60
WINDOWS = "array<struct<s:int,e:int>>"


HIT = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("len", T.IntegerType())])


@F.pandas_udf(T.ArrayType(HIT))
def entity_hits(texts: pd.Series, entities: pd.Series) -> pd.Series:
    """Every start of every entity, case-insensitive and overlapping, with the entity's length."""

    def hits(text, wanted):
        found, lowered = [], (text or "").lower()
        for entity in wanted if wanted is not None else ():
            needle = (entity or "").lower().strip()
            at = lowered.find(needle) if needle else -1
            while at >= 0:
                found.append({"s": at, "len": len(entity)})
                at = lowered.find(needle, at + 1)
        return found

    return pd.Series([hits(t, e) for t, e in zip(texts, entities)])


def context_windows(text: Column, hits: Column, width: int = 300) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(
            F.greatest(F.lit(0), h["s"] - width).alias("s"),
            F.least(F.length(text), h["s"] + h["len"] + width).alias("e"),
        ),
    )


def merge_windows(windows: Column) -> Column:
    """Sorted windows with overlapping and touching ones joined."""

    def add(done: Column, w: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], w["e"]).alias("e"))
        return F.when(
            (F.size(done) > 0) & (w["s"] <= last["e"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)),
        ).otherwise(F.concat(done, F.array(w)))

    return F.aggregate(F.array_sort(windows), F.array().cast(WINDOWS), add)


def assemble(text: Column, merged: Column, limit: int = 1200) -> Column:
    """Chunks of text under a budget; the first one over it is cut, or left out when little fits."""
    size = F.length(text)
    start = F.struct(
        F.array().cast("array<string>").alias("parts"),
        F.lit(0).alias("used"),
        F.lit(False).alias("full"),
    )

    def add(state: Column, w: Column) -> Column:
        chunk = F.concat(
            F.when(w["s"] > 0, F.lit(CUT_MARK)).otherwise(F.lit("")),
            F.substring(text, w["s"] + 1, w["e"] - w["s"]),
            F.when(w["e"] < size, F.lit(CUT_MARK)).otherwise(F.lit("")),
        )

        def step(c: Column) -> Column:
            room = F.lit(limit) - state["used"]
            fits = F.length(c) <= room
            cut = F.concat(F.left(c, room), F.lit(CUT_MARK))
            parts = F.when(fits, F.concat(state["parts"], F.array(c))).otherwise(
                F.when(
                    room > MIN_LAST_CHUNK, F.concat(state["parts"], F.array(cut))
                ).otherwise(state["parts"])
            )
            return F.struct(
                parts.alias("parts"),
                F.when(fits, state["used"] + F.length(c)).otherwise(state["used"]).alias("used"),
                (~fits).alias("full"),
            )

        return F.when(state["full"], state).otherwise(let(chunk, step))

    return F.aggregate(
        merged, start, add, lambda state: F.array_join(state["parts"], CHUNK_JOIN)
    )


def snippet(text: Column, hits: Column, width: int = 300, limit: int = 1200) -> Column:
    """The text around the hits; head and tail of the text when there are none."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.size(hits) == 0, head_tail(text, limit)).otherwise(
        assemble(text, merge_windows(context_windows(text, hits, width)), limit)
    )
