"""Reading message logs: arrays in JSON files, JSON lines, Parquet, time windows, envelopes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.operators.ranks import numbered
from logveil.schema import LOG_RECORD
from logveil.scratch import stage
from logveil.sources import arrays

# Names under which an envelope may hold its records, first match wins.
ENVELOPE_NAMES = ("logs", "records", "data", "results")
# Fixed value: spellings of an empty JSON value, which a string can have as well.
UNCLEAR = r"^(\[\]|\{\}|false|null|-?0(\.0*)?([eE][-+]?\d+)?)$"
WHOLE = 16 << 20  # bytes of an array file up to which one task reads it
# files of an array log are numbered; each gets room for this many records
FILE_ROOM = 2**36

_OUTSIDE = re.compile("[\"'{}]")
_INSIDE = {'"': re.compile(r'\\.|"', re.DOTALL), "'": re.compile(r"\\.|'", re.DOTALL)}


def _objects(body: str) -> Iterator[str]:
    """Top-level `{...}` pieces of a text; braces inside quotes do not count."""
    at, depth, start, quote = 0, 0, 0, None
    while True:
        found = (_INSIDE[quote] if quote else _OUTSIDE).search(body, at)
        if not found:
            return
        at, mark = found.end(), found.group()
        if quote:
            quote = None if mark == quote else quote
        elif mark == "{":
            start = found.start() if depth == 0 else start
            depth += 1
        elif mark == "}" and depth > 0:
            depth -= 1
            if depth == 0:
                yield body[start:at]
        elif mark in _INSIDE:
            quote = mark


def _array_members(content: str) -> Iterator[tuple[str, bool]]:
    """Members of a JSON array as text; of a broken array the members that parse by themselves."""
    try:
        whole = json.loads(content)
    except json.JSONDecodeError:
        first, last = content.find("["), content.rfind("]")
        if first < 0 or last < 0:
            raise
        for piece in _objects(content[first + 1 : last]):
            try:
                json.loads(piece)
                yield piece, True
            except json.JSONDecodeError:
                yield piece, False
        return
    if not isinstance(whole, list):
        raise ValueError(f"expected a JSON array, got {type(whole).__name__}")
    for member in whole:
        yield json.dumps(member, ensure_ascii=False), True


def array_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, record_json, ok) for files that each hold one JSON array.

    Files of more than `WHOLE` bytes are cut into byte ranges that are read side by side (see `arrays`); smaller
    ones are read as a whole, a task each, with the same result. Of the large ones only what does not begin like an
    array is read as a whole, to tell a broken log from something that is no log.
    """
    files = spark.read.format("binaryFile").load(path)
    large = [row["path"] for row in files.where(F.col("length") > WHOLE).select("path").collect()]
    small = _whole_members(files.where(F.col("length") <= WHOLE))
    if not large:
        return small
    found, begun = arrays.members(spark, large)
    others = stage(
        files.where(F.col("length") > WHOLE)
        .select(F.col("_metadata.file_path").alias("file"))
        .join(begun, "file", "left_anti"),
        "other-files",
    )
    found = small.unionByName(found)
    if others.isEmpty():
        return found
    return found.unionByName(_whole_members(files, others))


def _whole_members(files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The members of files that are read in one piece, of those named in `only` if it is given."""
    texts = files.select(
        F.col("_metadata.file_path").alias("file"),
        F.regexp_replace(decoded(F.col("content")), "^﻿", "").alias("text"),
    )
    texts = texts if only is None else texts.join(only, "file", "left_semi")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text in zip(batch["file"], batch["text"]):
                rows = []
                for pos, (member, ok) in enumerate(_array_members(text)):
                    rows.append((file, pos, member, ok))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file", "pos", "record_json", "ok"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "pos", "record_json", "ok"])

    return texts.mapInPandas(split, "file string, pos bigint, record_json string, ok boolean")


def file_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, with bytes that are not UTF-8 replaced."""
    return F.make_valid_utf8(content.cast("string"))


def skipped_members(members: DataFrame) -> DataFrame:
    return members.groupBy("file").agg(
        F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("skipped")
    )


def with_event_time(records: DataFrame) -> DataFrame:
    return records.withColumn("event_ts", F.try_to_timestamp(F.nullif("created_at", F.lit(""))))


def parsed(rows: DataFrame, raw: str, schema: T.StructType) -> DataFrame:
    """`rows` with the JSON objects in `raw` spread into the columns of `schema`.

    The type of `errors` is looked up where its text may be an empty value or a string that
    only spells one.
    """
    others = [c for c in rows.columns if c != raw]
    typed = F.to_json(F.from_json(raw, "errors variant")["errors"])
    unclear = F.col("errors").rlike(UNCLEAR)
    return (
        rows.withColumn("_r", F.from_json(raw, schema))
        .select(*others, raw, "_r.*")
        .withColumn("errors", F.when(unclear, F.coalesce(typed, "errors")).otherwise(F.col("errors")))
        .select(*others, *schema.names)
    )


def read_array_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-array files in file and array order, broken members left out."""
    members = array_members(spark, path).where("ok")
    order = numbered(file_names(spark, path), [], ["file"], "file_no")
    return with_event_time(
        parsed(
            members.join(order, "file").select(
                ((F.col("file_no") - 1) * F.lit(FILE_ROOM) + F.col("pos")).alias("seq"),
                "record_json",
            ),
            "record_json",
            LOG_RECORD,
        )
    )


def read_lines_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines files, which Spark splits; each line carries its own `seq`."""
    schema = T.StructType([T.StructField("seq", T.LongType()), *LOG_RECORD.fields])
    lines = spark.read.text(path).where(F.trim("value") != "")
    return with_event_time(parsed(lines, "value", schema))


def read_table_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- time windows


def window_bounds(
    now: datetime,
    start: datetime | None = None,
    end: datetime | None = None,
    lookback_hours: int | None = None,
    default_hours: int = 72,
) -> tuple[datetime, datetime]:
    """Explicit bounds, or a look-back from `end` or now; both at once is an error."""
    if lookback_hours is not None and (start is not None or end is not None):
        raise ValueError("give either a look-back or explicit bounds")
    end = end or now
    hours = default_hours if lookback_hours is None else lookback_hours
    return start or end - timedelta(hours=hours), end


def read_window(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Records from `start` to `end`, both included; prunes on `event_date` where there is one.

    The dates are widened by a day each side, as the table may have been written in another time
    zone than the bounds are given in; `event_ts` decides.
    """
    if "event_date" in log.columns:
        day = timedelta(days=1)
        log = log.where(F.col("event_date").between(F.lit(start.date() - day), F.lit(end.date() + day)))
    return log.where((F.col("event_ts") >= F.lit(start)) & (F.col("event_ts") <= F.lit(end)))


# ------------------------------------------------------------------- envelopes


def unwrap(payloads: DataFrame, column: str, record: T.DataType = LOG_RECORD) -> DataFrame:
    """Records inside envelope objects or bare arrays, one row each, with their position."""
    lists = T.StructType([T.StructField(n, T.ArrayType(record)) for n in ENVELOPE_NAMES])
    raw = F.ltrim(F.col(column))
    box = F.from_json(F.col(column), lists)
    inside = F.when(raw.startswith("["), F.from_json(F.col(column), T.ArrayType(record)))
    found = F.coalesce(inside, *[box[name] for name in ENVELOPE_NAMES])
    checked = F.coalesce(
        found, F.raise_error(F.lit("no list of records in payload")).cast(T.ArrayType(record))
    )
    others = [c for c in payloads.columns if c != column]
    return payloads.select(*others, F.posexplode(checked).alias("pos", "record"))


def check_tenants(requested: DataFrame, known: DataFrame, skip: bool = False) -> DataFrame:
    """Requested tenants nobody knows; with any of them the read should not start."""
    missing = requested.select("tenant_id").distinct().join(
        known.select("tenant_id").distinct(), "tenant_id", "left_anti"
    )
    return missing.where(F.lit(not skip))


def require_tenants(requested: DataFrame, known: DataFrame, skip: bool = False) -> None:
    if skip:
        return
    unknown = [r["tenant_id"] for r in check_tenants(requested, known).limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown tenants, among them {unknown}")
