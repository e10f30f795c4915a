"""Ranked lexical search for many items at once, with the work that items share done once.

Items are the queries. Their distinct terms are mined for shared sets: terms that stand in the same
items become one set, and then the two sets that most items hold together are joined again and
again. That gives a graph of sums: a leaf is the accumulator of one term over the documents of a
slice (what the term adds to each document's score), an inner node is the sum of two nodes and is
computed once for all items below it, and an item is the sum of the few nodes that remain for it.

Documents are scanned twice and never shuffled: once for the counts that scores need (documents,
terms, documents per term of an item), once for the scores. A task keeps the best `top` documents of each
item; those of all tasks meet in two rankings, the first one salted by task.

Items come in blocks of about `BLOCK_TERMS` (item, term) rows, by a hash of the item, so that what
is collected, mined and broadcast at a time is bounded whatever their number; one item is never cut, so a
block is at least the distinct terms of one item. `WIDTH` bounds mining only (pairs are looked for among
the most shared sets of an item) and never changes a result.

Defined cases: a null text or one without terms is no document and no item, but its item_id then has no
rows; rows of one item_id are one item with the terms of all; a null item_id is an item of its own;
repeated document rows are documents of their own and get a rank each; a null doc_id comes before all
others among equal scores and stays null (the least long is read as null); empty tables give an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.llm.tops import Tops
from logveil.llm.words import MARKS, Words, released, shipped, words
from logveil.scratch import stage

TOP = 50
BLOCK_TERMS = 1 << 16
WIDTH = 64
CELLS = 1 << 22
NO_ID = -(1 << 63)
# Letters, digits and all beyond ASCII make terms; only A-Z are folded.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------ shared sums


@dataclass
class Sums:
    """Nodes 0 to n_terms - 1 are terms; node n_terms + k is left[k] + right[k]; items are sums of nodes."""

    n_terms: int
    left: np.ndarray
    right: np.ndarray
    levels: list[np.ndarray]  # inner nodes that only need nodes of earlier levels
    roots: np.ndarray  # nodes of all items, one item after another
    begin: np.ndarray  # where each item begins there

    def __len__(self) -> int:
        return self.n_terms + len(self.left)

    def scores(self, leaves: np.ndarray) -> np.ndarray:
        """(items, documents) from the (terms, documents) accumulators."""
        held = np.zeros((len(self), leaves.shape[1]), np.int64)
        held[: self.n_terms] = leaves
        for some in self.levels:
            held[self.n_terms + some] = held[self.left[some]] + held[self.right[some]]
        return np.add.reduceat(held[self.roots], self.begin, axis=0)


def share(items: list[set[int]], n_terms: int, width: int = WIDTH) -> Sums:
    """Mine the sets of terms that items share; every item must have a term."""
    left, right, depth = [], [], []
    where: dict[int, set[int]] = defaultdict(set)
    for i, held in enumerate(items):
        for t in held:
            where[t].add(i)
    left_over = [set(held) for held in items]

    def level(node: int) -> int:
        return 0 if node < n_terms else depth[node - n_terms]

    def join(a: int, b: int, holders: set[int]) -> int:
        node = n_terms + len(left)
        left.append(a), right.append(b), depth.append(1 + max(level(a), level(b)))
        for i in holders:
            left_over[i] -= {a, b}
            left_over[i].add(node)
        where[a] -= holders
        where[b] -= holders
        where[node] = set(holders)
        return node

    same = defaultdict(list)
    for t, holders in sorted(where.items()):
        if len(holders) > 1:
            same[frozenset(holders)].append(t)
    for holders, group in sorted(same.items(), key=lambda g: g[1]):
        while len(group) > 1:  # pairwise, so that the sums stay shallow
            rest = group[len(group) // 2 * 2 :]
            group = [join(a, b, set(holders)) for a, b in zip(group[::2], group[1::2])] + rest

    def widest(i: int) -> list[int]:
        shared = [n for n in left_over[i] if len(where[n]) > 1]
        return sorted(sorted(shared, key=lambda n: (-len(where[n]), n))[:width])

    pairs: Counter = Counter()
    for i in range(len(items)):
        some = widest(i)
        pairs.update((a, b) for k, a in enumerate(some) for b in some[k + 1 :])
    heap = [(-n, a, b) for (a, b), n in pairs.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        holders = where[a] & where[b]
        if len(holders) < 2:
            continue
        if len(holders) < -n:
            heapq.heappush(heap, (-len(holders), a, b))
            continue
        node = join(a, b, holders)
        met = Counter(x for i in holders for x in widest(i) if x != node)
        for x, count in met.items():
            if count > 1:
                heapq.heappush(heap, (-count, min(x, node), max(x, node)))
    rows = [sorted(s) for s in left_over]
    levels: dict[int, list[int]] = defaultdict(list)
    for k, d in enumerate(depth):
        levels[d].append(k)
    as_array = lambda x: np.array(x, np.int64)
    return Sums(
        n_terms,
        as_array(left),
        as_array(right),
        [as_array(levels[d]) for d in sorted(levels)],
        as_array([n for row in rows for n in row]),
        as_array(np.cumsum([0, *[len(row) for row in rows[:-1]]])),
    )


# ------------------------------------------------------------------ terms in texts


class Lexicon:
    """Terms by hash; a hit is confirmed byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        w = next(iter_whole(terms))
        order = np.argsort(w.hash, kind="stable")
        self.number, self.hash = order, w.hash[order]
        self.start, self.size, self.bytes = w.start[order], (w.end - w.start)[order], w.bytes
        self.most = int(np.unique(self.hash, return_counts=True)[1].max())

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of every word of the slice that is a term."""
        first, size = np.searchsorted(self.hash, w.hash), w.end - w.start
        found = []
        for k in range(self.most):
            at = np.minimum(first + k, len(self.hash) - 1)
            word = np.flatnonzero((self.hash[at] == w.hash) & (self.size[at] == size))
            for some in np.array_split(word, max(1, int(size[word].sum()) >> 20)):
                if len(some):
                    good = some[self._equal(w, some, at[some])]
                    found.append((good, self.number[at[good]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f for f, _ in found]), np.concatenate([t for _, t in found])

    def _equal(self, w: Words, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(begin, size)
        mine = w.bytes[np.repeat(w.start[word], size) + step]
        return np.logical_and.reduceat(mine == self.bytes[np.repeat(self.start[at], size) + step], begin)


def iter_whole(terms: list[str]) -> Iterator[Words]:
    """One slice with all the terms, each of which is one word of its own text."""
    joined = pa.array([" ".join(terms)], pa.string())
    return words(joined, MARKS, lower=True)


def _counts(lexicon: Lexicon, w: Words, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of a slice."""
    word, term = lexicon.find(w)
    doc = np.searchsorted(w.cut, word, "right") - 1
    key, often = np.unique(doc * n_terms + term, return_counts=True)
    return key // n_terms, key % n_terms, often


# ------------------------------------------------------------------ tasks


def _counter(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, n_terms = block()
        docs, total, holding = 0, 0, np.zeros(n_terms, np.int64)
        for batch in batches:
            for w in words(batch["text"], MARKS, lower=True):
                docs += int((w.counts > 0).sum())
                total += len(w.hash)
                holding += np.bincount(_counts(lexicon, w, n_terms)[1], minlength=n_terms)
        used = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], used])), pa.array(np.concatenate([[docs, total], holding[used]]))],
            ["term", "n"],
        )

    return run


def _lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The length term of each document; plain integers where 64 bits would not do."""
    if 50 * docs * int(n.max(initial=0)) >= 1 << 63:
        return np.array([50 + 50 * int(x) * docs // total for x in n], np.int64)
    return 50 + 50 * n.astype(np.int64) * docs // total


def _ranker(block, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, sums, weight, docs, total = block()
        best = Tops(len(sums.begin), top)
        step = max(1, CELLS // (len(sums) + len(sums.roots)))
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for w in words(batch["text"], MARKS, lower=True):
                doc, term, often = _counts(lexicon, w, sums.n_terms)
                m = _lengths(w.counts, docs, total)[doc]
                adds = weight[term] * (10**9 * often // (1000 * often + 20 * m))
                there = np.unique(doc)
                row = np.searchsorted(there, doc)
                for a in range(0, len(there), step):
                    some = there[a : a + step]
                    x, y = np.searchsorted(row, [a, a + len(some)])
                    leaves = np.zeros((sums.n_terms, len(some)), np.int64)
                    leaves[term[x:y], row[x:y] - a] = adds[x:y]
                    score = sums.scores(leaves)
                    item, at = np.nonzero((score > 0) & (score >= best.floor[:, None]))
                    best.add(item, score[item, at], ids[w.first + some[at]])
        item, score, key = best.cut()
        for a in range(0, len(item), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[part]), pa.array(key[part]), pa.array(score[part])], ["item", "doc_id", "score"]
            )

    return run


# ------------------------------------------------------------------ search


def _weights(holding: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(n) + 1))) for n in holding], np.int64)


def item_terms(benchmark: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Written rows (item_id, term, block): the distinct terms of each item."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    rows = benchmark.select("item_id", F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term"))
    held = stage(rows.distinct(), "item-terms")
    blocks = max(1, math.ceil(held.count() / block_terms))
    return held.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))


def search(documents: DataFrame, benchmark: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item."""
    spark = documents.sparkSession
    texts = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    held = item_terms(benchmark, block_terms)
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType().add("item_id", kind).add("rank", T.IntegerType())
    schema = schema.add("doc_id", T.LongType()).add("score", T.LongType())
    parts = [
        _search_block(texts, held.where(F.col("block") == row["block"]), kind, top)
        for row in held.select("block").distinct().orderBy("block").collect()
    ]
    found = spark.createDataFrame([], schema)
    for part in parts:
        found = found.unionByName(part)
    return found


def _search_block(texts: DataFrame, held: DataFrame, kind: T.DataType, top: int) -> DataFrame:
    spark = texts.sparkSession
    rows = held.select("item_id", "term").orderBy("item_id", "term").collect()  # of one block: bounded
    terms = sorted({r["term"] for r in rows})
    number = {t: k for k, t in enumerate(terms)}
    items: dict = defaultdict(set)
    for r in rows:
        items[r["item_id"]].add(number[r["term"]])
    lexicon = Lexicon(terms)
    block = shipped(spark, (lexicon, len(terms)))
    counted = texts.select("text").mapInArrow(released(_counter(block)), "term bigint, n bigint")
    counts = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    docs, total = counts.get(-2, 0), counts.get(-1, 0)
    weight = _weights(np.array([counts.get(k, 0) for k in range(len(terms))]), docs)
    sums = share(list(items.values()), len(terms))
    plan = shipped(spark, (lexicon, sums, weight, docs, max(total, 1)))
    found = texts.mapInArrow(released(_ranker(plan, top)), "item bigint, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc("doc_id")]
    near = Window.partitionBy("item", "salt").orderBy(*order)
    whole = Window.partitionBy("item").orderBy(*order)
    best = (
        found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
        .withColumn("rank", F.row_number().over(near))
        .where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= top)
    )
    names = spark.createDataFrame(
        list(enumerate(items)), T.StructType().add("item", T.LongType()).add("item_id", kind)
    )
    return best.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"
    )
