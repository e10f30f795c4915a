"""JSON-array files of any size, read by all cores.

An array has no line ends to split at, but its objects end in `}`. Spark's text reader cuts files into byte
ranges and into records at a separator; with `}` as the separator each range of a file is a
*split* of whole records. What the characters of a split mean depends on what came before: whether it begins
inside a string, and how deep inside brackets. A first pass tells for each split how it would
change that for every state it could begin in; these changes are small rows, composed per file in order. The second pass knows the state each split
begins in, cuts out its members, and sends the pieces at its borders on to be joined.

A file is *sound* if it is one array whose members all parse. In a file that begins like an array and is not
sound, every `{...}` outside quotes (of either kind) up to the last `]` is tried by itself, in the same
two passes with the rules of salvage. A file that does not begin with `[` is read in one task.

What is broadcast is one small row per split, about a millionth of the log.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logveil.scratch import stage

#: before and after: the separators around a piece, null at the border of a split; `$` ends a file.
PIECE = "file string, at bigint, number bigint, before string, after string, text string, ok boolean, end bigint"
FEW_FILES = 10_000  # so many names of broken files are broadcast to skip the sound ones before Python
_BRACKETS = np.zeros(256, np.int8)
_BRACKETS[list(b"[{")], _BRACKETS[list(b"]}")] = 1, -1


def split_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, file_size, size, text): the parts of each file between `}`, split by split in order."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").cast("long").alias("at"),
        F.col("_metadata.file_size").cast("long").alias("file_size"),
        F.octet_length("value").cast("long").alias("size"),
        F.make_valid_utf8("value").alias("text"),
    )


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[int], str, bool]]:
    """((file, at, file_size), sizes, text, whether the split ends here) for each batch of a split."""
    held = None
    for batch in batches:
        key = batch["file"] + "\0" + batch["at"].astype(str)
        for _, part in batch.groupby((key != key.shift()).cumsum(), sort=False):
            first = part.iloc[0]
            now = (first["file"], int(first["at"]), int(first["file_size"]))
            if held:
                yield (*held, held[0] != now)
            held = now, part["size"].tolist(), "}".join(part["text"]) + "}"
    if held:
        yield (*held, True)


# ------------------------------------------------------------------ sound arrays


def _outside(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(brackets and commas outside strings, which of all such are, inside a string at the end)."""
    quotes = np.flatnonzero(data == 0x22)
    plain = np.maximum.accumulate(np.where(data != 0x5C, np.arange(len(data)), -1))
    before = np.where(quotes > 0, quotes - 1 - plain[quotes - 1], 0)  # backslashes right before
    quotes = quotes[before % 2 == 0]
    marks = np.flatnonzero((_BRACKETS[data] != 0) | (data == 0x2C))
    odd = np.searchsorted(quotes, marks) % 2 == 1
    return marks, odd == inside, inside ^ (len(quotes) % 2 == 1)


class Lexed:
    """What a split does to the state it begins in: for a begin outside and one inside a string."""

    def __init__(self) -> None:
        self.inside, self.net, self.bytes, self.first = [False, True], [0, 0], 0, ""

    def add(self, sizes: list[int], text: str) -> None:
        data = np.frombuffer(text.encode(), np.uint8)
        self.bytes += sum(sizes) + len(sizes)
        self.first = self.first or text.lstrip("﻿ \t\r\n")[:1]
        marks, odd_out, flips = _outside(data, False)
        moves = _BRACKETS[data[marks]]
        out = int(moves[odd_out].sum()), int(moves[~odd_out].sum())
        for k in (0, 1):
            self.net[k] += out[self.inside[k]]
            self.inside[k] ^= flips


def _lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = Lexed()
    for (file, at, file_size), sizes, text, ends in _runs(batches):
        state.add(sizes, text)
        if ends:
            yield pd.DataFrame(
                [(file, at, file_size, state.bytes, state.first, *state.inside, *state.net)],
                columns=["file", "at", "file_size", "bytes", "first", "inside_0", "inside_1", "net_0", "net_1"],
            )
            state = Lexed()


def _compose(splits: pd.DataFrame) -> pd.DataFrame:
    """The state each split of one file begins in, and whether its last record has no `}` after it."""
    splits = splits.sort_values("at")
    inside, depth, states = False, 0, []
    for row in splits.itertuples():
        states.append((inside, depth))
        depth += row.net_1 if inside else row.net_0
        inside = bool(row.inside_1 if inside else row.inside_0)
    # as many bytes as the file has, or three less where a byte order mark went: the last `}` is real
    bare = int(splits["bytes"].sum()) - int(splits["file_size"].iloc[0]) not in (0, -3)
    return pd.DataFrame(
        {
            "file": splits["file"], "at": splits["at"], "inside": [s[0] for s in states], "depth": [s[1] for s in states],
            "last": np.arange(len(splits)) == len(splits) - 1, "bare": bare, "first": "".join(splits["first"])[:1],
        }
    )


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


class Pieces:
    """Collects the pieces of one split; those that began in it are numbered."""

    def __init__(self, file: str, at: int, begins: str | None, judge: Callable[[str | None, str, str], bool | None]) -> None:
        self.file, self.at, self.before, self.number, self.held = file, at, begins, -1, []
        self.rows: list[tuple] = []
        self.judge = judge
        self.number += begins is not None

    def close(self, text: str, after: str | None, end: int = 0) -> None:
        text = "".join([*self.held, text])
        ok = self.judge(self.before, text, after) if self.before and after else None
        self.rows.append((self.file, self.at, self.number, self.before, after, text, ok, end))
        self.held = []

    def taken(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])


def judged(before: str, text: str, after: str) -> bool:
    """Members have to parse; around the array there has to be nothing. `[]` has one blank piece."""
    if before in "[," and after in ",]":
        return _parses(text) or (before, after) == ("[", "]") and not text.strip()
    return not text.strip("﻿ \t\r\n") and (before, after) in (("^", "["), ("]", "$"))


def _cutter(states: Any) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, known = None, states.value
        for (file, at, _), _, text, ends in _runs(batches):
            inside, depth, last, bare, first = known[file, at] if out is None else (inside, depth, last, bare, first)
            if first != "[":
                continue
            out = out or Pieces(file, at, None if at else "^", judged)
            if ends and last and bare:
                text = text[:-1]
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            marks, outside, inside = _outside(data, inside)
            marks = marks[outside]
            moves = _BRACKETS[data[marks]].astype(np.int64)
            deep = depth + np.cumsum(moves)
            level = np.where(moves < 0, deep + 1, deep)  # inside or at the bracket itself
            cuts = marks[(level == 1) & (data[marks] != 0x7B) & (data[marks] != 0x7D)]
            depth, from_ = int(deep[-1]) if len(deep) else depth, 0
            for cut in cuts.tolist():
                mark = chr(data[cut])
                out.close(raw[from_:cut].decode(), mark)
                out.before, out.number, from_ = mark, out.number + 1, cut + 1
            out.held.append(raw[from_:].decode())
            if ends:
                out.close("", "$" if last else None)
            if len(out.rows):
                yield out.taken()
            if ends:
                out = None

    return run


# ------------------------------------------------------------------ salvage

_OUTSIDE = re.compile("[\"'{}]")
_INSIDE = {'"': re.compile(r'\\.|"', re.DOTALL), "'": re.compile(r"\\.|'", re.DOTALL)}
QUOTES = ("", '"', "'")


def marks_of(text: str, quote: str) -> Iterator[tuple[str, int]]:
    """Braces outside quotes with the place after them, then the quote that is open at the end."""
    at = 0
    while found := (_INSIDE[quote] if quote else _OUTSIDE).search(text, at):
        at, mark = found.end(), found.group()
        if quote:
            quote = "" if mark == quote else quote
        elif mark in _INSIDE:
            quote = mark
        else:
            yield mark, at
    yield quote, -1


def _lex_broken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split and quote it could begin in: the quote at its end, and depth as max(depth + net, least)."""
    ends_in, net, least, offset, bracket = list(QUOTES), [0] * 3, [0] * 3, 0, -1
    for (file, at, file_size), sizes, text, ends in _runs(batches):
        for k in range(3):
            for mark, place in marks_of(text, ends_in[k]):
                if place < 0:
                    ends_in[k] = mark
                elif mark == "{":
                    net[k], least[k] = net[k] + 1, least[k] + 1
                else:
                    net[k], least[k] = net[k] - 1, max(least[k] - 1, 0)
        bracket = max(bracket, offset + text.rfind("]") if "]" in text else -1)
        offset += len(text)
        if ends:
            rows = [(file, at, file_size, k, QUOTES.index(ends_in[k]), net[k], least[k], bracket) for k in range(3)]
            yield pd.DataFrame(rows, columns=["file", "at", "file_size", "begins", "ends", "net", "least", "bracket"])
            ends_in, net, least, offset, bracket = list(QUOTES), [0] * 3, [0] * 3, 0, -1


def _compose_broken(rows: pd.DataFrame) -> pd.DataFrame:
    quote, depth, out = 0, 0, []
    for at, split in rows.sort_values(["at", "begins"]).groupby("at", sort=True):
        out.append((rows["file"].iloc[0], at, quote, depth, int(split["bracket"].iloc[0])))
        own = split.iloc[quote]
        quote, depth = int(own["ends"]), max(depth + int(own["net"]), int(own["least"]))
    return pd.DataFrame(out, columns=["file", "at", "quote", "depth", "bracket"])


def _salvager(states: Any) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, known, quote, depth, offset = None, states.value, "", 0, 0
        for (file, at, _), _, text, ends in _runs(batches):
            if (file, at) not in known:
                continue
            if out is None:
                number, depth = known[file, at]
                quote, offset = QUOTES[number], 0
                out = Pieces(file, at, None, lambda _, text, __: _parses(text))
            start = 0
            for mark, place in marks_of(text, quote):
                if place < 0:
                    quote = mark
                elif mark == "{":
                    depth += 1
                    if depth == 1:
                        out.before, out.number, start, out.held = "{", out.number + 1, place - 1, []
                elif depth:
                    depth -= 1
                    if depth == 0:
                        out.close(text[start:place], "}", offset + place - 1)
                        out.before = None
            if depth:
                out.held.append(text[start:])
            offset += len(text)
            if ends and depth:
                out.close("", None)
            if len(out.rows):
                yield out.taken()
            if ends:
                out = None

    return run


# ------------------------------------------------------------------ both


def _join_pieces(judge: Callable) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pieces of one file that border on splits, in order, joined where one goes on in the next split."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, begun = [], None
        for row in rows.sort_values(["at", "number", "end"]).itertuples(index=False):
            if pd.isna(row.before) and begun is not None:
                begun = [*begun[:5], begun[5] + [row.text]]
            else:
                begun = [row.file, row.at, row.number, row.before, None, [row.text]]
            if not pd.isna(row.after):
                text = "".join(begun[5])
                if not pd.isna(begun[3]):
                    ok = judge(begun[3], text, row.after)
                    out.append((*begun[:4], row.after, text, ok, row.end if row.at == begun[1] else 1 << 62, row.at, row.end))
                begun = None
        names = [c.split()[0] for c in PIECE.split(", ")] + ["end_at", "end_in"]
        return pd.DataFrame(out, columns=names)

    return run


def _whole(pieces: DataFrame, judge: Callable) -> DataFrame:
    """The pieces of all files, none of which ends at the border of a split any more."""
    pieces = stage(pieces, "pieces")
    border = F.col("before").isNull() | F.col("after").isNull()
    joined = (
        pieces.where(border)
        .groupBy("file")
        .applyInPandas(_join_pieces(judge), PIECE + ", end_at bigint, end_in bigint")
    )
    inner = pieces.where(~border).withColumns({"end_at": F.col("at"), "end_in": F.col("end")})
    return inner.unionByName(stage(joined, "joined"))


def _numbered(members: DataFrame) -> DataFrame:
    """(file, pos, record_json, ok): places count the members of earlier splits, then those of the own one."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = members.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("least"))
    starts = counts.select("file", "at", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return members.join(stage(starts, "starts"), ["file", "at"]).select(
        "file",
        (F.col("start") + F.col("number") - F.col("least")).alias("pos"),
        F.btrim("text", F.lit(" \t\r\n")).alias("record_json"),
        "ok",
    )


def _states(splits: DataFrame, columns: list[str]) -> Any:
    rows = splits.select("file", "at", *columns).collect()
    return splits.sparkSession.sparkContext.broadcast({(r[0], r[1]): tuple(r[2:]) for r in rows})


def members(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(file, pos, record_json, ok) of all files that begin like an array, and the names of these."""
    records = split_records(spark, path)
    lexed = records.mapInPandas(
        _lex,
        "file string, at bigint, file_size bigint, bytes bigint, first string, inside_0 boolean, inside_1 boolean, "
        "net_0 bigint, net_1 bigint",
    )
    ddl = "file string, at bigint, inside boolean, depth bigint, last boolean, bare boolean, first string"
    splits = stage(lexed.groupBy("file").applyInPandas(_compose, ddl), "splits")
    states = _states(splits, ["inside", "depth", "last", "bare", "first"])
    pieces = _whole(records.mapInPandas(_cutter(states), PIECE), judged)
    broken = stage(
        pieces.groupBy("file").agg(F.min("ok").alias("sound")).where("not sound").select("file"), "broken-files"
    )
    blank = (F.col("before") == "[") & (F.col("after") == "]") & (F.trim("text") == "")
    inside = F.col("before").isin("[", ",") & F.col("after").isin(",", "]") & ~blank
    found = _numbered(pieces.where(inside).join(broken, "file", "left_anti"))
    number = broken.limit(FEW_FILES + 1).count()
    if number:
        some = records.join(F.broadcast(broken), "file", "left_semi") if number <= FEW_FILES else records
        found = found.unionByName(_salvaged(some, broken))
    return found, splits.where("first = '['").select("file").distinct()


def _salvaged(records: DataFrame, broken: DataFrame) -> DataFrame:
    lexed = records.mapInPandas(
        _lex_broken,
        "file string, at bigint, file_size bigint, begins int, ends int, net bigint, least bigint, bracket bigint",
    )
    ddl = "file string, at bigint, quote int, depth bigint, bracket bigint"
    splits = stage(
        lexed.join(broken, "file", "left_semi").groupBy("file").applyInPandas(_compose_broken, ddl), "broken-splits"
    )
    pieces = _whole(records.mapInPandas(_salvager(_states(splits, ["quote", "depth"])), PIECE), lambda _, t, __: _parses(t))
    last = splits.where("bracket >= 0").groupBy("file").agg(F.max(F.struct("at", "bracket")).alias("last"))
    checked = splits.select("file").distinct().join(last, "file", "left").select(
        "file", F.coalesce("last", F.raise_error(F.lit("no array in file")).cast("struct<at:bigint,bracket:bigint>")).alias("last")
    )
    inside = pieces.join(stage(checked, "ends"), "file").where(F.struct("end_at", "end_in") < F.col("last"))
    return _numbered(inside.drop("last"))
