"""Language identification with a bidirectional gated recurrent network over bytes.

A text's bytes are cut into stretches of `STRETCH` that are read at the same time, each in both
directions from a zero state; every byte gets class probabilities from the two states at
its place, and a document's are their mean over all its bytes. All bytes of every text are read.

The network is trained here in numpy, by backpropagation through time with exact gradients, on a
bounded sample: at most `SAMPLE` labelled documents per language, the ones with the least
hash of doc_id, and of each `SPAN` characters from a place that the hash decides. Only text and lang
are read for it; documents whose crc32 of doc_id is 0 modulo 5 are never learned from. Prediction
sees the text alone.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is everything when
there is nothing to learn from. A null doc_id is not learned from and not held out. An empty table
gives an empty result; repeated rows each get their row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.llm.words import buffers, released

SAMPLE, SPAN, STRETCH, UNITS = 250, 384, 96, 8
BATCH, EPOCHS, RATE = 256, 6, 0.03
LANES = 2048  # stretches that are read together in prediction


def _squashed(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place, between -1 and 1: a few plain steps, where exp or tanh would be most of the cost."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    """The same between 0 and 1."""
    _squashed(x)
    x *= 0.5
    x += 0.5
    return x


def _squashed_slope(value: np.ndarray) -> np.ndarray:
    return (1 - np.abs(value)) ** 2


def _gate_slope(value: np.ndarray) -> np.ndarray:
    return 0.5 * _squashed_slope(2 * value - 1)


@dataclass
class Network:
    """Per direction and gate (z, r, candidate): inputs by byte (256 x h) and recurrent weights (h x h)."""

    languages: list[str]
    into: np.ndarray  # 2 x 3 x 256 x h
    again: np.ndarray  # 2 x 3 x h x h
    out: np.ndarray  # 2h + 1 rows, the last for the bias

    def states(self, symbols: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """(steps, lanes, h): states after each byte of `symbols` (steps x lanes)."""
        h = self.again.shape[3]
        state = np.zeros((symbols.shape[1], h), self.into.dtype)
        found = np.empty((*symbols.shape, h), self.into.dtype)
        into, again = self.into[way], self.again[way]
        for t, given in enumerate(symbols):
            z = state @ again[0]
            z += into[0].take(given, 0)
            _gate(z)
            r = state @ again[1]
            r += into[1].take(given, 0)
            _gate(r)
            past = state @ again[2]
            new = r * past
            new += into[2].take(given, 0)
            _squashed(new)
            if keep is not None:
                keep.append((state, z, r, new, past))
            state = state - new
            state *= z
            state += new
            found[t] = state
        return found

    def labels(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Class probabilities at every position."""
        h, k = forward.shape[2], self.out.shape[1]
        score = forward.reshape(-1, h) @ self.out[:h]
        score += backward.reshape(-1, h) @ self.out[h : 2 * h]
        score += self.out[2 * h]
        np.clip(score, -30, 30, out=score)
        np.exp(score, out=score)
        score /= score @ np.ones((k, k), score.dtype)  # each row's sum in every column
        return score.reshape(*forward.shape[:2], k)


def _mirrored(values: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each lane of (steps, lanes, ...) reversed within its length."""
    if length.min() == len(values):
        return values[::-1]
    step = np.arange(len(values))[:, None]
    mirror = np.where(step < length, length - 1 - step, step)
    return np.take_along_axis(values, mirror.reshape(*mirror.shape, *[1] * (values.ndim - 2)), 0)


def _stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, begin, length) of the stretches of all texts."""
    n = -(-np.diff(at) // STRETCH)
    owner = np.repeat(np.arange(len(n)), n)
    begin = at[owner] + STRETCH * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    return owner, begin, np.minimum(STRETCH, at[owner + 1] - begin)


def _symbols(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of stretches as steps x lanes, zero after their ends."""
    step = np.arange(length.max())[:, None]
    live = step < length
    return np.where(live, data[np.where(live, begin + step, begin)], 0)


def pooled(net: Network, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean class probabilities of each text; zero for an empty one."""
    sums = np.zeros((len(at) - 1, len(net.languages)))
    owner, begin, length = _stretches(data, at)
    order = np.argsort(length, kind="stable")
    for a in range(0, len(order), LANES):
        some = order[a : a + LANES]
        forth = _symbols(data, begin[some], length[some])
        back = _mirrored(forth, length[some])
        probabilities = net.labels(net.states(forth, 0), _mirrored(net.states(back, 1), length[some]))
        if length[some].min() < len(forth):
            probabilities *= (np.arange(len(forth))[:, None] < length[some])[:, :, None]
        own = probabilities.sum(0, dtype=np.float64)
        for k in range(own.shape[1]):
            sums[:, k] += np.bincount(owner[some], own[:, k], len(sums))
    return sums / np.maximum(np.diff(at), 1)[:, None]


def gradients(net: Network, forth: np.ndarray, length: np.ndarray, label: np.ndarray):
    """(loss, gradients of into, again and out) of the mean cross-entropy over live positions."""
    h, lanes = net.again.shape[3], np.arange(forth.shape[1])
    live = np.arange(len(forth))[:, None] < length
    kept: tuple[list, list] = ([], [])
    ways = (forth, _mirrored(forth, length))
    ahead = net.states(ways[0], 0, kept[0])
    behind = _mirrored(net.states(ways[1], 1, kept[1]), length)
    gap = net.labels(ahead, behind)
    loss = -np.log(gap[:, lanes, label] + 1e-12)[live].sum() / live.sum()
    gap[:, lanes, label] -= 1
    gap *= live[:, :, None] / gap.dtype.type(live.sum())
    flat = gap.reshape(-1, gap.shape[2])
    out = np.concatenate([ahead.reshape(-1, h).T @ flat, behind.reshape(-1, h).T @ flat, flat.sum(0)[None]])
    into, again = np.zeros_like(net.into), np.zeros_like(net.again)
    for way, symbols in enumerate(ways):
        pull = gap @ net.out[way * h : (way + 1) * h].T
        if way:
            pull = _mirrored(pull, length)
        slopes = np.empty((3, *pull.shape), pull.dtype)  # at the gates' inputs
        carried = np.zeros_like(pull[0])
        for t in range(len(symbols) - 1, -1, -1):
            before, z, r, new, past = kept[way][t]
            total = pull[t] + carried
            d_new = total * (1 - z) * _squashed_slope(new)
            d_z = total * (before - new) * _gate_slope(z)
            d_r = d_new * past * _gate_slope(r)
            slopes[0, t], slopes[1, t], slopes[2, t] = d_z, d_r, d_new
            back = net.again[way]
            carried = total * z + d_z @ back[0].T + d_r @ back[1].T + (d_new * r) @ back[2].T
        states = np.stack([k[0] for k in kept[way]]).reshape(-1, h)
        gates = np.stack([k[2] for k in kept[way]]).reshape(-1, h)
        order = np.argsort(symbols.ravel(), kind="stable")
        seen, begin = np.unique(symbols.ravel()[order], return_index=True)
        for g in range(3):
            own = slopes[g].reshape(-1, h)
            into[way, g, seen] = np.add.reduceat(own[order], begin)
            again[way, g] = states.T @ (own * gates if g == 2 else own)
    return loss, into, again, out


def train(texts: list[bytes], labels: list[str]) -> Network:
    """Adam over shuffled stretches; the random numbers are seeded, so equal samples give equal networks."""
    rng = np.random.default_rng(7)
    languages = sorted(set(labels))
    k, h = len(languages), UNITS
    net = Network(
        languages,
        rng.normal(0, 0.3, (2, 3, 256, h)).astype(np.float32),
        rng.normal(0, 0.5 / np.sqrt(h), (2, 3, h, h)).astype(np.float32),
        rng.normal(0, 0.1, (2 * h + 1, k)).astype(np.float32),
    )
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    owner, begin, length = _stretches(data, at)
    label = np.array([languages.index(x) for x in labels])[owner]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.into, net.again, net.out)]
    step, steps = 0, EPOCHS * -(-len(owner) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(owner))
        for a in range(0, len(order), BATCH):
            some, step = order[a : a + BATCH], step + 1
            _, *slopes = gradients(net, _symbols(data, begin[some], length[some]), length[some], label[some])
            rate = RATE * (1 - step / (steps + 1))
            for p, g, (m, v) in zip((net.into, net.again, net.out), slopes, moments):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fold(doc_id):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(documents: DataFrame) -> Network | None:
    """Train on the sample; None when no labelled text is left."""
    text = F.col("text").cast("string")
    spread = F.greatest(F.length(text) - SPAN, F.lit(0)) + 1
    rows = (
        documents.where((fold("doc_id") != 0) & F.col("lang").isNotNull() & (F.length(text) > 0))
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("lang").cast("string").alias("lang"),
            F.substring(text, F.pmod(F.xxhash64("doc_id", F.lit(1)), spread).cast("int") + 1, F.lit(SPAN)).alias("part"),
        )
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "part")))
        .where(F.col("r") <= SAMPLE)
        .orderBy("lang", "r")
        .collect()
    )
    return train([r.part.encode() for r in rows], [r.lang for r in rows]) if rows else None


def _predictor(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch["text"])
            means = pooled(net, data, at)
            best = means.argmax(1)
            known = np.diff(at) > 0
            names = [net.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
            score = np.where(known, np.clip(means.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return run


def predict(documents: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) per document."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    if net is None:
        return documents.select(doc_id, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = documents.select(doc_id, F.when(text.rlike(r"\p{L}"), text).alias("text"))
    return rows.mapInArrow(released(_predictor(net)), "doc_id bigint, lang_pred string, score double")
