"""Quality rules: base figures of a text, and a line labeller that decides retention.

The labeller is a linear-chain conditional random field over the lines of a text (parts between
newlines that hold a word) with the states boilerplate and content. Viterbi decoding gives the most
likely sequence; a text is kept when its content lines hold at least `SHARE` of its word characters
and no base rule fails.

The field is trained here, on a bounded sample: at most `SAMPLE` labelled texts of each quality, the
ones with the least hash of doc_id, and of each at most `LINES` lines and `CHARS` characters, so what comes to the
driver is bounded. Lines start out with the label of their text. The field trained on these then says of each
line what its own features make of it; where that outweighs the text's label by `PRIOR` (in log odds), the line
changes sides, and the field is trained again, `TURNS` times. So a text may hold lines of both kinds, and the chain
learns where they meet. Without labels of both kinds every line counts as content. Everything else runs over
whole texts, in place, without a shuffle.

Defined cases: a null text has no words and fails; an empty table gives an empty result;
repeated rows each get their row; labels with a null or unknown doc_id are not used, and doc_ids
labelled more than once count by their first label in order of quality. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.llm.rows import packed
from logveil.llm.words import BLANKS, Words, _hashes, covered, mix, per_text, windows, words, released

SAMPLE, LINES, CHARS, SHARE, ROUNDS = 400, 40, 20_000, 0.25, 80
PRIOR, TURNS = 1.0, 2
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[ord("!")] = True


@dataclass
class Lines:
    """Lines with a word: `cut` says which belong to each text, `chars` their word characters."""

    cut: np.ndarray
    chars: np.ndarray
    features: np.ndarray
    hash: np.ndarray


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def _first_seen(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Mask of the places whose value occurs for the first time in its text."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    new = np.ones(len(values), bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    first = np.empty(len(values), bool)
    first[order] = new
    return first


def lines(w: Words) -> Lines:
    data = w.bytes
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([w.text_at[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    if len(starts):
        ends = ends - ((ends > starts) & (data[ends - 1] == 0x0A))
    n_words = np.searchsorted(w.start, ends) - np.searchsorted(w.start, starts)
    starts, ends, n_words = starts[n_words > 0], ends[n_words > 0], n_words[n_words > 0]
    text = np.searchsorted(w.text_at, starts, "right") - 1
    count = lambda m: (lambda s: s[ends] - s[starts])(_sums(m))
    letters = count(~BLANKS[data] & ((data & 0xC0) != 0x80))
    first_word = np.searchsorted(w.start, starts)
    line_of = np.repeat(np.arange(len(starts)), n_words)
    member = np.repeat(first_word, n_words) + np.arange(len(line_of)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    fresh = np.bincount(line_of[_first_seen(line_of, w.hash[member])], minlength=len(starts))
    hashes = _hashes(data, starts, ends)
    share = lambda m, of: count(m) / np.maximum(of, 1)
    symbols, capitals = share(SYMBOLS[data], n_words), share(_CAPITAL[data], letters)
    shouts, digits = share(_SHOUT[data], n_words), share(_DIGIT[data], letters)
    variety = fresh / n_words
    features = np.stack(
        [
            np.ones(len(starts)),
            n_words <= 3,
            (n_words > 3) & (n_words <= 12),
            symbols > 0.1,
            symbols > 0.5,
            capitals > 0.3,
            shouts > 0.3,
            digits > 0.2,
            variety < 0.3,
            (variety >= 0.3) & (variety < 0.6),
            letters / n_words > 12,
            ~_first_seen(text, hashes),
        ],
        axis=1,
    ).astype(np.float64)
    return Lines(np.searchsorted(text, np.arange(len(w) + 1)), letters, features, hashes)


# ------------------------------------------------------------------ the field


@dataclass
class Field:
    """State 1 is content. Scores of a line are features @ emit; `move[a, b]` follows state a by b."""

    emit: np.ndarray
    move: np.ndarray

    def content(self, cut: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Viterbi: mask of the content lines; texts that still have a line advance together."""
        score = features @ self.emit
        n = np.diff(cut)
        came = np.zeros((len(features), 2), np.int8)
        best = np.zeros((len(n), 2))
        longest = int(n.max()) if len(n) else 0
        order = np.argsort(-n, kind="stable")
        alive = np.searchsorted(-n[order], -np.arange(longest), "left")
        for t in range(longest):
            some = order[: alive[t]]
            at = cut[some] + t
            if t:
                step = best[some][:, :, None] + self.move
                came[at] = step.argmax(1)
                best[some] = step.max(1)
            best[some] += score[at]
        state = np.zeros(len(features), bool)
        now = best.argmax(1) if len(n) else np.zeros(0, np.int64)
        for t in range(longest - 1, -1, -1):
            some = order[: alive[t]]
            last = n[some] == t + 1
            at = cut[some] + t
            now[some] = np.where(last, best[some].argmax(1), now[some])
            state[at] = now[some]
            now[some] = came[at, now[some]]
        return state


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(cut: np.ndarray, features: np.ndarray, content: np.ndarray, good: np.ndarray) -> Field:
    """Maximum likelihood by Adam with exact gradients from the forward-backward sums.

    content: the state of each line; good: the label of each text, by which texts are weighed evenly.
    """
    n_texts, width = len(cut) - 1, features.shape[1]
    n = np.diff(cut)
    longest = int(n.max())
    owner, place = np.repeat(np.arange(n_texts), n), np.arange(cut[-1]) - np.repeat(cut[:-1], n)
    x = np.zeros((n_texts, longest, width))
    x[owner, place] = features
    y = np.zeros((n_texts, longest), int)
    y[owner, place] = content
    live = np.arange(longest) < n[:, None]
    weight = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1)) / np.maximum(n, 1)
    theta = np.zeros(width * 2 + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        emit, move = theta[:-4].reshape(width, 2), theta[-4:].reshape(2, 2)
        score = x @ emit
        fore, back = score.copy(), np.zeros_like(score)
        for t in range(1, longest):
            fore[:, t] += _logsum(fore[:, t - 1, :, None] + move, 1)
        for t in range(longest - 2, -1, -1):
            into = _logsum(move + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(live[:, t + 1, None], into, 0)
        total = _logsum(fore + back, 2)
        state = np.exp(fore + back - total[:, :, None]) * live[:, :, None]
        pair = np.exp(
            fore[:, :-1, :, None] + move + (score + back)[:, 1:, None, :] - total[:, 1:, None, None]
        ) * live[:, 1:, None, None]
        true = np.eye(2)[y] * live[:, :, None]
        gap = (true - state) * weight[:, None, None]
        slope = np.concatenate([np.einsum("ntf,nts->fs", x, gap).ravel(), np.zeros(4)])
        seen = np.einsum("nta,ntb->ntab", true[:, :-1], true[:, 1:]) * live[:, 1:, None, None]
        slope[-4:] = ((seen - pair) * weight[:, None, None, None]).sum((0, 1)).ravel()
        slope -= 1e-4 * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:-4].reshape(width, 2), theta[-4:].reshape(2, 2))


def train_lines(cut: np.ndarray, features: np.ndarray, good: np.ndarray) -> Field:
    """Train on lines whose labels are corrected by what the field makes of each line alone."""
    of_text = np.repeat(good, np.diff(cut))
    field = train(cut, features, of_text, good)
    for _ in range(TURNS):
        odds = features @ (field.emit[:, 1] - field.emit[:, 0])
        content = odds + np.where(of_text, PRIOR, -PRIOR) > 0
        field = train(cut, features, content, good)
    return field


def fit(documents: DataFrame, labels: DataFrame) -> Field:
    """Train on at most 2 * SAMPLE texts, chosen by a hash of their doc_id."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .join(documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id")
        .withColumn("r", F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")))
        .where(F.col("r") <= SAMPLE)
        .select("doc_id", "quality")
        .collect()
    )
    known = {r.doc_id: r.quality for r in chosen}
    if set(known.values()) != {0, 1}:
        width = lines(next(words(pa.array(["a"])))).features.shape[1]
        return Field(np.stack([np.zeros(width), np.eye(width)[0]], 1), np.zeros((2, 2)))
    beginning = F.left(F.concat_ws("\n", F.slice(F.split("text", "\n"), 1, LINES)), F.lit(CHARS))
    texts = dict(
        documents.where(F.col("doc_id").cast("long").isin(list(known)))
        .select(F.col("doc_id").cast("long"), beginning)
        .collect()
    )
    order = sorted(texts)
    parts, cuts, kinds, at = [], [0], [], 0
    for w in words(pa.array([texts[i] for i in order], pa.string())):
        found = lines(w)
        parts.append(found.features)
        cuts.extend((found.cut[1:] + at).tolist())
        at += len(found.features)
        kinds.extend(known[i] == 1 for i in order[w.first : w.first + len(w)])
    return train_lines(np.array(cuts), np.concatenate(parts), np.array(kinds))


# ------------------------------------------------------------------ figures and verdict

_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def figures(w: Words, found: Lines) -> dict[str, np.ndarray]:
    place, h = windows(w, 3)
    owner = np.searchsorted(w.cut, place, "right") - 1
    own = mix(h ^ mix(owner.astype(np.uint64)))
    _, back, count = np.unique(own, return_inverse=True, return_counts=True)
    repeated = covered(place[count[back] > 1], 3, len(w.hash))
    text_sums = lambda m: np.diff(_sums(m)[w.text_at])
    line_text = np.repeat(np.arange(len(w)), np.diff(found.cut))
    again = ~_first_seen(line_text, found.hash)
    return {
        "n_words": w.counts,
        "word_chars": text_sums(~BLANKS[w.bytes] & ((w.bytes & 0xC0) != 0x80)),
        "n_symbols": text_sums(SYMBOLS[w.bytes]),
        "n_dup_lines": np.bincount(line_text[again], minlength=len(w)),
        "n_repeat_words": per_text(w, repeated),
    }


def _judge(field: Field, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch["text"]):
                found = lines(w)
                content = field.content(found.cut, found.features)
                of = lambda m: np.diff(_sums(m)[found.cut])
                share = of(found.chars * content) / np.maximum(of(found.chars), 1)
                row = figures(w, found)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[c][w.first : w.first + len(w)] for c in keep),
                        *(pa.array(row[c].astype(np.int64)) for c in _FIGURES),
                        pa.array(share),
                    ],
                    [*keep, *_FIGURES, "content_share"],
                )

    return run


def verdicts(documents: DataFrame, field: Field, whole_rows: bool = False) -> DataFrame:
    """(doc_id, the figures, content_share, base_failed, kept) per document.

    With `whole_rows`, a struct `row` of all columns stands in place of doc_id.
    """
    text = F.col("text").cast("string").alias("text")
    own = packed(documents) if whole_rows else F.col("doc_id").cast("long").alias("doc_id")
    rows = documents.select(own, text)
    schema = T.StructType([rows.schema[0]])
    for c in _FIGURES:
        schema = schema.add(c, T.LongType())
    schema = schema.add("content_share", T.DoubleType())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        rows.mapInArrow(released(_judge(field, rows.columns[:1])), schema)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("content_share") >= SHARE))
    )


def retained(documents: DataFrame, field: Field) -> DataFrame:
    """The documents that are kept, in place: no join brings the verdict back."""
    return verdicts(documents, field, whole_rows=True).where("kept").select("row.*")
