"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items; an item of fewer words is one pattern.
Patterns of one length share a shift table over blocks of two words: the block at which a window
ends says how far the search may jump. Only where the jump is zero are the suffix and prefix blocks
looked up in buckets, and the patterns found there are compared word by word with the text.
A text is cut into lanes of `LANE` window ends that advance together as arrays, which is the
usual loop for many places at once; every place is visited or skipped by the table.

The benchmark is cut in Spark to pieces of `PIECE` window starts, which overlap by the rest of a window,
so an item of any length is bounded pieces of one item_id. Pieces reach tasks in broadcast blocks of
about `BLOCK_WORDS` words, one built at a time. Several blocks are several passes over the same rows;
after `PASSES` of them hits are written. Documents are never shuffled.

Defined cases: a null text or item has no words, and such an item no pattern; an empty benchmark
hits nothing; an empty table gives an empty result; repeated documents each get their row;
items that share an item_id count as one, and a null item_id is an empty string. Other
columns are ignored, or kept by `retained`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.llm.rows import packed
from logveil.llm.words import MARKS, covered, mix, released, shipped, words
from logveil.scratch import stage

SIZE = 13
LANE = 512
BLOCK_WORDS, PIECE, PASSES = 1 << 20, 1 << 15, 4
# Fixed value: what is no word of letters, digits or characters beyond ASCII, once A-Z are folded.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE_BITS = 20
_PAIR = np.uint64(0xA24BAED4963EE407)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _PAIR + right)


class Patterns:
    """The patterns of one length: their word hashes and bytes, the shift table and the buckets."""

    def __init__(self, size: int, rows: dict[bytes, tuple[np.ndarray, set[str]]]) -> None:
        self.size, self.block = size, min(2, size)
        self.hashes = np.array([h for h, _ in rows.values()], np.uint64).reshape(len(rows), size)
        self.bytes = list(rows)
        self.items = [sorted(found) for _, found in rows.values()]
        self.shift = np.full(1 << _TABLE_BITS, size - self.block + 1, np.int16)
        for end in range(self.block, size + 1):
            at = self._slot(self._blocks(self.hashes, end - 1))
            np.minimum.at(self.shift, at, size - end)
        keys = self._key(self._blocks(self.hashes, size - 1), self._blocks(self.hashes, self.block - 1))
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    @staticmethod
    def _key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return suffix ^ (prefix * _PAIR)

    def _blocks(self, rows: np.ndarray, last: int) -> np.ndarray:
        return self.at(rows.T, last)

    def at(self, h: np.ndarray, last):
        """The hash of the block of words that ends at `last`."""
        return mix(h[last]) if self.block == 1 else _pairs(h[last - 1], h[last])

    def ends(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in `h` where a window may end: those the shift table does not skip."""
        found = []
        place = begin.copy()
        while len(place):
            jump = self.shift[self._slot(self.at(h, place))]
            found.append(place[jump == 0])
            place = place + np.maximum(jump, 1)
            going = place < end
            place, end = place[going], end[going]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, w) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all occurrences in a slice of texts."""
        spare = self.size - 1
        lanes = np.maximum((w.counts - spare + LANE - 1) // LANE, 0)
        owner = np.repeat(np.arange(len(w)), lanes)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = w.cut[owner] + spare + number * LANE
        end = np.minimum(begin + LANE, w.cut[owner + 1])
        last = self.ends(w.hash, begin, end)
        key = self._key(self.at(w.hash, last), self.at(w.hash, last - spare + self.block - 1))
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pattern, first = self.order[which], np.repeat(last, n) - spare
        same = np.ones(len(first), bool)
        for k in range(self.size):
            same &= w.hash[first + k] == self.hashes[pattern, k]
        pattern, first = pattern[same], first[same]
        confirmed = [
            b" ".join(
                w.bytes[a:b].tobytes() for a, b in zip(w.start[f : f + self.size], w.end[f : f + self.size])
            )
            == self.bytes[p]
            for f, p in zip(first.tolist(), pattern.tolist())
        ]
        kept = np.array(confirmed, bool)
        return first[kept], pattern[kept]


def patterns(items: list[tuple[str | None, str | None]]) -> list[Patterns]:
    """Search tables for the windows of the items, one per length of pattern."""
    ids = ["" if i is None else str(i) for i, _ in items]
    by_size: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
    for w in words(pa.array([t for _, t in items], pa.string()), MARKS, lower=True):
        data = w.bytes.tobytes()
        for i in range(len(w)):
            a, b = int(w.cut[i]), int(w.cut[i + 1])
            size = min(SIZE, b - a)
            for f in range(a, b - size + 1 if size else a):
                text = b" ".join(data[x:y] for x, y in zip(w.start[f : f + size], w.end[f : f + size]))
                rows = by_size.setdefault(size, {})
                rows.setdefault(text, (w.hash[f : f + size].copy(), set()))[1].add(ids[w.first + i])
    return [Patterns(size, rows) for size, rows in sorted(by_size.items())]


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    block, size = [], 0
    for row in _pieces(benchmark).toLocalIterator():
        if block and size + row["n"] > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["piece"]))
        size += row["n"]
    yield block


def _pieces(benchmark: DataFrame) -> DataFrame:
    """(item_id, piece, n): every window of an item lies in one of its pieces."""
    text = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    item = F.col("item_id").cast("string").alias("item_id")
    w = benchmark.select(item, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - SIZE, F.lit(0)), F.lit(PIECE))
    cut = w.select("item_id", "w", F.explode(starts).alias("at"))
    piece = F.slice("w", F.col("at") + 1, PIECE + SIZE - 1)
    return cut.select("item_id", F.array_join(piece, " ").alias("piece"), F.size(piece).alias("n"))


_FOUND = (
    T.StructType()
    .add("n_words", T.LongType())
    .add("n_hit", T.LongType())
    .add("hit", T.BinaryType())
    .add("items", T.ArrayType(T.StringType()))
)


def _scanner(opened):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = opened()
        for batch in batches:
            before = batch.to_pydict() if "hit" in batch.schema.names else None
            for w in words(batch["text"], MARKS, lower=True):
                mask, items = np.zeros(len(w.hash), bool), [set() for _ in range(len(w))]
                for p in search:
                    first, pattern = p.occurrences(w)
                    mask |= covered(first, p.size, len(w.hash))
                    doc = np.searchsorted(w.cut, first, "right") - 1
                    for d, k in set(zip(doc.tolist(), pattern.tolist())):
                        items[d].update(p.items[k])
                hits, n_hit = [], []
                for i in range(len(w)):
                    own = mask[w.cut[i] : w.cut[i + 1]]
                    if before:
                        own = own | np.unpackbits(
                            np.frombuffer(before["hit"][w.first + i], np.uint8), count=len(own)
                        ).astype(bool)
                        items[i].update(before["items"][w.first + i])
                    n_hit.append(int(own.sum()))
                    hits.append(np.packbits(own).tobytes())
                rows = slice(w.first, w.first + len(w))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["row"][rows],
                        batch["text"][rows],
                        pa.array(w.counts, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array(hits, pa.binary()),
                        pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                    ],
                    ["row", "text", *_FOUND.names],
                )

    return scan


def find_benchmark(documents: DataFrame, benchmark: DataFrame, whole_rows: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items): items is the sorted array of item_ids that occur.

    With `whole_rows`, a struct `row` of all columns stands in place of doc_id.
    """
    spark = documents.sparkSession
    own = packed(documents) if whole_rows else F.struct(F.col("doc_id").cast("long").alias("doc_id"))
    found = documents.select(own.alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*found.schema, *_FOUND])
    for number, block in enumerate(_item_blocks(benchmark)):
        if number and number % PASSES == 0:
            found = stage(found, "hits")
        found = found.mapInArrow(released(_scanner(shipped(spark, patterns(block)))), schema)
    return found.select("row" if whole_rows else "row.doc_id", "n_words", "n_hit", "items")


def retained(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, in place."""
    found = find_benchmark(documents, benchmark, whole_rows=True)
    return found.where(~contaminated(F.col("n_hit"), F.col("n_words"))).select("row.*")


def contaminated(n_hit, n_words):
    """The rule: some word is hit, and at least one word in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)

