"""Chat formatting from an event log.

A log row is (conv_id, message, kind, role, text) with ordering columns. Kinds: `open` starts a
message with its role, `delta` appends streamed text, `edit` replaces the text so far, `regenerate`
drops it so that the deltas that follow make it anew, `delete` removes the message.

Messages fold independently of one another, so the log is partitioned by conversation and message,
sorted by sequence, and folded as a stream: a conversation with a third of all rows is spread over
many tasks. Every final message is rendered as a piece of its conversation with the character ranges
that count for the loss, and a conversation's text is its pieces in order. `read_back` walks the pieces
of a conversation as a stream, so it holds one piece at a time; only its running digests, which
cannot be split, tie a conversation to one task.

Template: `<|turn|>` role newline text `<|end|>` newline. Control strings in texts and roles,
also those of other public templates, get a backslash after their first character (one more if
they already have some), so the template's own never occur inside and the change can be undone.

Defined cases: null texts and roles are empty; an empty log gives no pieces; equal places in the
sequence are taken in the order of the ordering columns given; events of a message before its `open`
are kept, a message never opened has an empty role; unknown kinds raise; a null conv_id is
a conversation of its own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.words import released

# Control strings of public chat templates.
_CONTROL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role_in(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_out(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """The piece of a message, and its loss ranges: the text of an assistant."""
    head, body = f"<|turn|>{_role_in(role)}\n", escape(text)
    spans = [(len(head), len(head) + len(body))] if role == "assistant" else []
    return f"{head}{body}<|end|>\n", spans


def turns(piece: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn that a piece of formatted text holds."""
    for found in _TURN.finditer(piece):
        yield _role_out(found[1]), unescape(found[2])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[Iterator[dict]]:
    """Consecutive rows with equal keys, one group at a time, as streams."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        key = [row[k] for k in keys]

        def group() -> Iterator[dict]:
            nonlocal row
            while row is not None and [row[k] for k in keys] == key:
                yield row
                row = next(rows, None)

        run = group()
        yield run
        for _ in run:  # what the reader left
            pass


def _fold(order: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for events in _runs(batches, ["conv_id", "message"]):
            first, role, parts, there = None, "", [], True
            for e in events:
                first = first or e
                kind, text = e["kind"], e["text"] or ""
                if kind == "open":
                    role, there = e["role"] or "", True
                    parts.append(text)
                elif kind == "delta":
                    parts.append(text)
                elif kind == "edit":
                    parts = [text]
                elif kind == "regenerate":
                    parts = [text]
                elif kind == "delete":
                    there = False
                else:
                    raise ValueError(f"unknown event: {kind}")
            if there:
                piece, spans = render(role, "".join(parts))
                place = {c: first[c] for c in order}
                loss = [{"begin": a, "end": b} for a, b in spans]
                out.append({"conv_id": first["conv_id"], **place, "message": first["message"], "piece": piece, "loss": loss})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def format_events(events: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, *order, message, piece, loss): one row per final message, placed by its first event.

    `order` names long columns; conv_id and message are longs too.
    """
    longs = ["conv_id", *order, "message"]
    rows = events.select(
        *(F.col(c).cast("long") for c in longs), F.col("kind"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([*((c, pa.int64()) for c in longs), ("piece", pa.string()), ("loss", span)])
    ddl = ", ".join(f"{c} bigint" for c in longs)
    return (
        rows.repartition("conv_id", "message")
        .sortWithinPartitions("conv_id", "message", *order)
        .mapInArrow(released(_fold(order, schema)), f"{ddl}, piece string, loss array<struct<begin: bigint, end: bigint>>")
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pieces in _runs(batches, ["conv_id"]):
        n, size, lost, whole, loss, conv = 0, 0, 0, hashlib.sha256(), hashlib.sha256(), None
        for row in pieces:
            conv, piece = row["conv_id"], row["piece"]
            size += len(piece)
            for role, text in turns(piece):
                n += 1
                whole.update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                text = unescape(piece[span["begin"] : span["end"]])
                lost += len(text)
                loss.update(text.encode())
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "conv_id": conv,
                    "n_turns": n,
                    "turns_sha256": whole.hexdigest(),
                    "loss_chars": lost,
                    "loss_sha256": loss.hexdigest(),
                    "formatted_chars": size,
                }
            ],
            schema=_READ,
        )


_READ = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def read_back(pieces: DataFrame, order: list[str]) -> DataFrame:
    """What the formatted conversations say: turns and loss text, unescaped, as digests."""
    return (
        pieces.select("conv_id", *order, "message", "piece", "loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", *order, "message")
        .mapInArrow(
            released(_read),
            "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
            "formatted_chars bigint",
        )
    )


def logged(conversations: DataFrame) -> DataFrame:
    """The event log that rows (conv_id, turn, role, text) stand for.

    An assistant's text streams in two deltas after a first try that is regenerated; the others
    arrive whole and are edited to what they said, so every kind of change is folded. Rows at the
    same turn are separate messages, by role and text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda step, kind, role, t: F.struct(
        F.lit(step).alias("step"), F.lit(kind).alias("kind"), role.alias("role"), t.alias("text")
    )
    no, role = F.lit(None).cast("string"), F.col("role").cast("string")
    streamed = F.array(
        event(0, "open", role, F.lit("")),
        event(1, "delta", no, F.substring(text, 1, half)),
        event(2, "regenerate", no, F.lit("")),
        event(3, "delta", no, F.substring(text, 1, half)),
        event(4, "delta", no, F.substring(text, half + 1, F.length(text))),
    )
    whole = F.array(event(0, "open", role, F.substring(text, 1, half)), event(1, "edit", no, text))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("tie"),
        F.monotonically_increasing_id().alias("message"),
        F.when(role == "assistant", streamed).otherwise(whole).alias("events"),
    )
    return rows.select("conv_id", "turn", "tie", "message", F.inline("events"))
