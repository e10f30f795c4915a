"""Hard negatives: threshold joins of anchors with all rows, thresholds lowered until windows fill.

The first join finds each anchor's most similar rows of its own label (positives). Each positive then
opens a window of scores, and the second join finds the best rows of other labels in it. Both are joins above
a threshold per anchor, with an inverted index over the rows of a task in the manner of L2AP:

* components are ordered by how much of the anchors' squares they hold. A row's trailing components are left out
  of the index while the norm of that suffix times the largest suffix norm of an anchor stays under
  `OMIT` times the least threshold: rows are dealt to *postings* by where their indexed part ends, so the list
  of a component is the postings that reach it;
* anchors add up their scores over the postings. Pairs whose partial score plus the product of their
  remaining norms is under the threshold are pruned, the rest is added up for the survivors only;
* as soon as a task holds enough rows for a window, its last score is the window's threshold there.

First thresholds come from the scores in a sample of `SAMPLE` rows (by hash), at a rank where all rows should
fill the window. Windows that do not fill are joined again at a rank `LOWER` times as deep, then without
a threshold but the window's own. So the sample decides how much is compared, never a result.

Anchors are the query set. They come in blocks of about `BLOCK` components, by a hash of vec_id; a block is
broadcast, rows are scanned and never shuffled. What leaves a task is the best few rows of each open window.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no
part; vectors of different length are compared over their common leading components; components beyond
2**27 in size count as 2**27, so that scores stay whole 64-bit numbers (up to 500 such components); repeated
rows are rows of their own, but no row is a positive of its own vec_id, and of anchors that share a vec_id the
one with the least label and vector is taken; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logveil.llm.tops import Tops
from logveil.llm.vectors import matrices
from logveil.llm.words import released, shipped
from logveil.scratch import stage

BLOCK, SAMPLE, LOWER = 1 << 21, 2048, 4
OMIT, STEP, CELLS = 0.25, 8, 1 << 20
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = -(1 << 62), 1 << 62
_LIMIT = float(1 << 27)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, as whole numbers in double precision."""
    return np.clip(np.floor(256.0 * vectors), -_LIMIT, _LIMIT)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b; exact, by matrix product where doubles hold them."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def tails(x: np.ndarray) -> np.ndarray:
    """Norms of the suffixes: column k is that of components k and on."""
    squares = np.zeros((len(x), x.shape[1] + 1))
    squares[:, :-1] = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(squares)


@dataclass
class Anchors:
    """A block of anchors, and windows [low, high] per anchor; a closed window has low above high."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same: bool  # rows of the anchor's label, or of all others
    low: np.ndarray
    high: np.ndarray
    need: int


# ------------------------------------------------------------------ the join inside a task


def survivors(x: np.ndarray, y: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of all pairs whose score reaches the anchor's threshold."""
    dims = min(x.shape[1], y.shape[1])
    x, y = x[:, :dims], y[:, :dims]
    order = np.argsort(-(x * x).sum(axis=0), kind="stable")
    x, y = x[:, order], y[:, order]
    ends = np.array(sorted({*range(STEP, dims, STEP), dims}) if dims else [0])
    rest_x, rest_y = tails(x)[:, ends], tails(y)[:, ends]
    least = max(float(low.min()), 0.0)
    posting = (rest_y * rest_x.max(axis=0) <= OMIT * least).argmax(axis=1)  # the last always holds
    for p in np.unique(posting).tolist():
        rows, end = np.flatnonzero(posting == p), int(ends[p])
        step = max(1, CELLS // len(rows))
        for a in range(0, len(x), step):
            some = slice(a, a + step)
            partial = dots(x[some, :end], y[rows, :end])
            remaining = rest_x[some, p][:, None] * rest_y[rows, p][None, :]
            i, j = np.nonzero(partial + remaining >= low[some, None] - 1.0)  # 1: rounding of the norms
            score = partial[i, j]
            if end < dims:
                left = np.einsum(
                    "ij,ij->i", x[a + i, end:].astype(np.int64), y[rows[j], end:].astype(np.int64)
                )
                score = score + left
            good = score >= low[a + i]
            yield a + i[good], rows[j[good]], score[good]


def _joiner(opened: Callable[[], Anchors]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = opened()
        n, windows = block.low.shape
        best = Tops(n * windows, block.need, block.low.ravel())
        for batch in batches:
            ids, labels = batch["vec_id"].to_numpy(), batch["label"].to_numpy(zero_copy_only=False)
            for rows, given in matrices(batch["vec"]):
                vectors = whole(given)
                for part in _parts(block, labels[rows]):
                    _join(block, best, *part, vectors, ids[rows])
        slot, score, key = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(key), pa.array(score)], ["slot", "vec_id", "score"])

    return run


def _parts(block: Anchors, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, rows) that may meet: label by label, so that no other pair is looked at."""
    for label in np.unique(block.labels):
        mine = np.flatnonzero(block.labels == label)
        rows = np.flatnonzero((labels == label) == block.same)
        if len(rows):
            yield mine, rows


def _join(block: Anchors, best: Tops, mine: np.ndarray, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
    windows = block.low.shape[1]
    for a in range(0, len(mine), 256):
        some = mine[a : a + 256]
        slots = some[:, None] * windows + np.arange(windows)
        floor = np.where(block.low[some] <= block.high[some], best.floor[slots], MOST)
        live = floor.min(axis=1) < MOST
        some, slots, floor = some[live], slots[live], floor[live]
        if not len(some):
            continue
        for i, j, score in survivors(block.vectors[some], vectors[rows], floor.min(axis=1)):
            key = ids[rows[j]]
            other = key != block.ids[some[i]]
            i, score, key = i[other], score[other], key[other]
            for k in range(windows):
                fits = (score >= floor[i, k]) & (score <= block.high[some[i], k])
                best.add(slots[i[fits], k], score[fits], key[fits])


# ------------------------------------------------------------------ rounds


def _rows(embeddings: DataFrame, vector: str) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part."""
    vec = F.col(vector).cast("array<double>")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), vec.alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("vec_id is not null and label is not null").where(sound)


def _padded(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for k, row in enumerate(rows):
        out[k, : len(row["vec"])] = row["vec"]
    return whole(out)


def _first_lows(block: Anchors, sample: Anchors, share: float, rank: int) -> np.ndarray:
    """Per window the score at `rank` among the sample's rows in it, or the window's own end."""
    out = block.low.copy()
    if share >= 1:
        return out
    for a in range(0, len(block.ids), 256):
        some = slice(a, a + 256)
        score = dots(block.vectors[some], sample.vectors)
        same = block.labels[some, None] == sample.labels[None, :]
        use = (same == block.same) & (block.ids[some, None] != sample.ids[None, :])
        for k in range(out.shape[1]):
            inside = use & (score >= block.low[some, k, None]) & (score <= block.high[some, k, None])
            ranked = -np.sort(np.where(inside, -score, MOST), axis=1)
            at = ranked[:, rank - 1] if rank <= ranked.shape[1] else np.full(len(ranked), -MOST)
            out[some, k] = np.where(at > -MOST, np.maximum(at, block.low[some, k]), block.low[some, k])
    return out


def _fill(rows: DataFrame, block: Anchors, sample: Anchors, share: float) -> list[DataFrame]:
    """Written (slot, vec_id, score) tables that hold the best rows of every window once."""
    spark = rows.sparkSession
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    is_open = block.low <= block.high
    rank, parts = max(1, math.ceil(block.need * share)), []
    while is_open.any():
        floor = _first_lows(block, sample, share, rank)
        floor = np.where(is_open, floor, MOST)
        last = bool((floor <= block.low)[is_open].all())
        opened = shipped(spark, replace(block, low=floor))
        found = rows.mapInArrow(released(_joiner(opened)), "slot bigint, vec_id bigint, score bigint")
        best = stage(
            found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block.need), "windows"
        )
        filled = np.zeros(is_open.size, bool)
        for row in best.where(F.col("rank") == block.need).select("slot").toLocalIterator():
            filled[row["slot"]] = True
        done = is_open & (filled.reshape(is_open.shape) | (floor <= block.low))
        slots = spark.createDataFrame([(int(s),) for s in np.flatnonzero(done.ravel())], "slot bigint")
        parts.append(best.join(slots, "slot", "left_semi"))
        is_open = is_open & ~done
        rank = rank * LOWER
        if last:
            break
    return parts


def mine(
    embeddings: DataFrame,
    is_anchor: Column,
    vector: str = "embedding",
    block: int = BLOCK,
    sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = embeddings.sparkSession
    rows = _rows(embeddings, vector)
    n = rows.count()
    known = Anchors(*_collected(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)), *[None] * 4)
    anchors = stage(
        rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("a")).select("vec_id", "a.*"),
        "anchors",
    )
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    blocks = math.ceil(size["n"] * max(size["dims"] or 0, 1) / block)
    out = spark.createDataFrame(
        [],
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    )
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        for part in _mine_block(rows, _collected(own), known, len(known.ids) / max(n, 1)):
            out = out.unionByName(part)
    return out


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and whole vectors of a block or sample (bounded), in order of id."""
    found = sorted(rows.collect(), key=lambda r: r["vec_id"])
    dims = max((len(r["vec"]) for r in found), default=0)
    ids, labels = (np.array([r[c] for r in found], np.int64) for c in ("vec_id", "label"))
    return ids, labels, _padded(found, dims)


def _mine_block(rows: DataFrame, own: tuple, sample: Anchors, share: float) -> list[DataFrame]:
    spark = rows.sparkSession
    n = len(own[0])
    if not n:
        return []
    sample = replace(sample, vectors=_fitted(sample.vectors, own[2].shape[1]))
    every = Anchors(*own, True, np.full((n, 1), LEAST), np.full((n, 1), MOST), POSITIVES)
    positive_id, score = np.zeros((n, POSITIVES), np.int64), np.zeros((n, POSITIVES), np.int64)
    there = np.zeros((n, POSITIVES), bool)
    for part in _fill(rows, every, sample, share):
        for r in part.toLocalIterator():  # a block's positives: bounded
            at = r["slot"], r["rank"] - 1
            positive_id[at], score[at], there[at] = r["vec_id"], r["score"], True
    low, high = -(-score // 2), 95 * score // 100  # 50 p <= 100 s <= 95 p in whole numbers
    low, high = np.where(there, low, 0), np.where(there, high, -1)
    windows = replace(every, same=False, low=low, high=high, need=NEGATIVES)
    slot = np.flatnonzero(there.ravel())
    names = stage(
        spark.createDataFrame(
            list(zip(slot.tolist(), own[0][slot // POSITIVES].tolist(), positive_id.ravel()[slot].tolist(), score.ravel()[slot].tolist())),
            "slot long, anchor_id long, positive_id long, positive_score long",
        ),
        "positives",
    )
    return [
        part.join(names, "slot").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
        for part in _fill(rows, windows, sample, share)
    ]


def _fitted(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Cut or padded with zeros to `dims` components."""
    out = np.zeros((len(vectors), dims))
    out[:, : vectors.shape[1]] = vectors[:, :dims]
    return out
