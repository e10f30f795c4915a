"""Substring deduplication behind a count-min prefilter.

A word of a document goes when a window of `size` consecutive words that covers it also starts
earlier: in a document with a smaller id, or earlier in the same one. Windows are judged on the
input, never on what is left of it.

Documents are dealt to blocks by a hash of their id, once; the three passes below read the same
exchange, so each text is shuffled once.

1. *Sketch.* Every window is represented by its anchor, the least 8-word hash in it: equal windows
   have equal anchors at equal places, so an anchor occurs at least as often as each window it
   stands for. A block counts anchors in a count-min sketch of `DEPTH` rows; only the cells that
   it uses are sent, cut into shards. Merging a shard tells each block which of its cells are
   also used by another.
2. *Exact count.* Windows whose cells all count two or more (no repeated window can be missing) are
   grouped by a 128-bit hash, with the earliest place as the result. A block sends one row per
   window, so a window in a third of all documents is a grouped minimum with partial sums.
3. *Removal.* The earliest places go back to their blocks; there every other occurrence of a
   window from pass 2 marks its words.

Exact copies of a text are found first by a grouping on its hash: of each group only the documents
with the smallest id are counted, as all windows of the others start earlier.

No sketch and no list reaches the driver, and none is broadcast, so nothing is bounded by one
machine but a block and a shard. Both follow the bytes of the input (`BLOCK` and `SHARD` each), not the
number of partitions; a block sends a row per shard in which it uses a cell, so there are
never more rows than cells.

Defined cases: a null text has no words; documents under `size` words keep all; an empty table gives
an empty result; rows that share a doc_id count as one document laid over itself (equal rows do
not remove each other); a null doc_id comes before all others. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.words import Words, covered, mix, per_text, windows, words

SIZE, ANCHOR = 20, 8
DEPTH, WIDTH = 2, 1 << 40
BLOCK, SHARD = 4 << 20, 32 << 20  # bytes of text
SEEDS = tuple(np.uint64(s * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for s in range(1, DEPTH + 1))


def _pack(sorted_cells: np.ndarray) -> bytes:
    """Ascending numbers as differences, the bytes of equal weight side by side, deflated."""
    steps = np.diff(sorted_cells, prepend=np.uint64(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


class Block:
    """The windows of one block of documents, those of later exact copies left out."""

    def __init__(self, docs: pa.Table, firsts: np.ndarray, size: int, short: int) -> None:
        self.size = size
        docs = docs.combine_chunks()
        self.key = docs["key"].to_numpy()
        self.first = np.isin(self.key, firsts)
        self.texts = docs["text"].chunk(0) if len(docs) else pa.array([], pa.string())
        self.slices: list[tuple[Words, np.ndarray, int]] = []
        parts: dict[str, list[np.ndarray]] = {n: [] for n in ("anchor", "h1", "h2", "doc", "at")}
        for w in words(self.texts):
            place, h1 = windows(w, size, 1)
            doc = np.searchsorted(w.cut, place, "right") - 1
            chosen = self.first[w.first + doc]
            place, h1, doc = place[chosen], h1[chosen], doc[chosen]
            self.slices.append((w, place, len(place)))
            parts["anchor"].append(self._anchors(w, place, short))
            parts["h1"].append(h1)
            h2 = windows(w, size, 2)
            parts["h2"].append(h2[1][chosen])
            parts["doc"].append(w.first + doc)
            parts["at"].append(place - w.cut[doc])
        joined = {n: np.concatenate(p) if p else np.zeros(0, np.uint64) for n, p in parts.items()}
        self.anchor, self.h1, self.h2 = joined["anchor"], joined["h1"], joined["h2"]
        self.doc, self.at = joined["doc"].astype(np.int64), joined["at"].astype(np.int64)

    @staticmethod
    def _anchors(w: Words, place: np.ndarray, short: int) -> np.ndarray:
        """One number per window and place of its anchor: the anchor's hash, and where it is."""
        inner, h = windows(w, short, 3)
        at = np.full(len(w.hash) + 1, np.iinfo(np.uint64).max, np.uint64)
        at[inner] = h
        best, where = at[place], place.copy()
        for step in range(1, SIZE - short + 1):
            other = at[place + step]
            less = other < best
            best = np.where(less, other, best)
            where[less] = place[less] + step
        return np.rec.fromarrays([best, where], names="hash,where")

    def cells(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each window in a row of the sketch; distinct anchor places count once."""
        return mix(self.anchor["hash"] ^ SEEDS[row]) % np.uint64(WIDTH)

    def used(self, row: int, shards: int):
        """(cells of the windows, distinct cells, local counts, shard of each distinct cell)."""
        cell = self.cells(row)
        new = np.ones(len(cell), bool)  # neighbouring windows share an anchor
        new[1:] = (self.anchor["where"][1:] != self.anchor["where"][:-1]) | (self.doc[1:] != self.doc[:-1])
        own, count = np.unique(cell[new], return_counts=True)
        return cell, own, count, own % np.uint64(shards)


def _empty(schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([], schema)


_SKETCH = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("row", pa.int32()), ("cells", pa.binary())])
_FLAGS = pa.schema([("block", pa.int32()), ("row", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())])
_SUSPECTS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.int64()), ("at", pa.int32())])
_KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]
)
_DDL = {
    "sketch": "shard int, block int, row int, cells binary",
    "flags": "block int, row int, shard int, bits binary",
    "suspects": "h1 bigint, h2 bigint, key bigint, at int",
    "kept": "doc_id bigint, n_words bigint, n_removed bigint, kept_text string",
}


def _ids(notes: pa.Table, kind: str) -> np.ndarray:
    return notes.filter(pc.equal(notes["kind"], kind))["key"].to_numpy()


def _sketcher(size: int, short: int, shards: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(docs):
            return _empty(_SKETCH)
        block, number = Block(docs, _ids(notes, "first"), size, short), docs["block"][0].as_py()
        rows = []
        for row in range(DEPTH):
            _, own, _, shard = block.used(row, shards)
            for s in np.unique(shard):
                rows.append((int(s), number, row, _pack(own[shard == s] // np.uint64(shards))))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _SKETCH)], schema=_SKETCH) if rows else _empty(_SKETCH)

    return run


def _merge(part: pa.Table) -> pa.Table:
    """Of one shard and row: which cells of each block are used by more than one block."""
    cells = [_unpack(c) for c in part["cells"].to_pylist()]
    every, count = np.unique(np.concatenate(cells), return_counts=True)
    shared = every[count > 1]
    bits = [np.packbits(np.isin(c, shared, assume_unique=True)).tobytes() for c in cells]
    return pa.table([part["block"], part["row"], part["shard"], pa.array(bits, pa.binary())], schema=_FLAGS)


def _suspected(block: Block, notes: pa.Table, shards: int) -> np.ndarray:
    """Mask of the windows that every row of the merged sketch counts at least twice."""
    mask = np.ones(len(block.h1), bool)
    flags = notes.filter(pc.equal(notes["kind"], "flags")).select(["row", "shard", "bits"]).to_pylist()
    for row in range(DEPTH):
        cell, own, count, shard = block.used(row, shards)
        often = count > 1
        for note in flags:
            if note["row"] == row:
                at = np.flatnonzero(shard == note["shard"])
                often[at] |= np.unpackbits(np.frombuffer(note["bits"], np.uint8), count=len(at)).astype(bool)
        if len(own):
            mask &= often[np.searchsorted(own, cell)]
    return mask


def _counter(size: int, short: int, shards: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(docs):
            return _empty(_SUSPECTS)
        block = Block(docs, _ids(notes, "first"), size, short)
        chosen = np.flatnonzero(_suspected(block, notes, shards))
        order = chosen[np.lexsort((block.at[chosen], block.key[block.doc[chosen]], block.h2[chosen], block.h1[chosen]))]
        h1, h2 = block.h1[order], block.h2[order]
        head = np.ones(len(order), bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        order = order[head]
        return pa.table(
            [
                pa.array(block.h1[order].view(np.int64)),
                pa.array(block.h2[order].view(np.int64)),
                pa.array(block.key[block.doc[order]]),
                pa.array(block.at[order].astype(np.int32)),
            ],
            schema=_SUSPECTS,
        )

    return run


def _remover(size: int, short: int, shards: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(docs):
            return _empty(_KEPT)
        block = Block(docs, _ids(notes, "first"), size, short)
        earliest = notes.filter(pc.equal(notes["kind"], "earliest"))
        kept_places = np.rec.fromarrays([earliest["key"].to_numpy(), earliest["at"].to_numpy().astype(np.int64)])
        places = np.rec.fromarrays([block.key[block.doc], block.at])
        gone = _suspected(block, notes, shards) & ~_among(places, kept_places)
        n_words, n_removed, texts = [], [], []
        offset = 0
        for w, place, n in block.slices:
            mask = covered(place[gone[offset : offset + n]], size, len(w.hash))
            copies = ~block.first[w.first : w.first + len(w)] & (w.counts >= size)
            mask |= np.repeat(copies, w.counts)
            n_words.append(w.counts)
            n_removed.append(per_text(w, mask))
            data = w.bytes.tobytes()
            for i in range(len(w)):
                own = data[w.text_at[i] : w.text_at[i + 1]].split()
                if n_removed[-1][i]:
                    own = compress(own, ~mask[w.cut[i] : w.cut[i + 1]])
                texts.append(b" ".join(own).decode())
            offset += n
        return pa.table(
            [
                docs["doc_id"],
                pa.array(np.concatenate(n_words).astype(np.int64)),
                pa.array(np.concatenate(n_removed).astype(np.int64)),
                pa.array(texts, pa.string()),
            ],
            schema=_KEPT,
        )

    return run


def _among(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Mask of `rows` (pairs of integers) that are in `others`."""
    a, b = rows.dtype.names
    keys = np.unique(np.concatenate([rows[a], others[others.dtype.names[0]]]))
    code = lambda x, y: np.searchsorted(keys, x).astype(np.int64) << 32 | y
    return np.isin(code(rows[a], rows[b]), code(others[others.dtype.names[0]], others[others.dtype.names[1]]))


def remove_repeats(documents: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row of (doc_id, text)."""
    if size != SIZE or not 0 < anchor <= size:
        raise ValueError("anchors are searched in windows of 20 words")
    cores = documents.sparkSession.sparkContext.defaultParallelism
    size_of_all = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks, shards = max(2 * cores, -(-size_of_all // BLOCK)), -(-size_of_all // SHARD) or 1
    lowest = F.lit(-(1 << 63)).cast("long")
    deal = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), lowest).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", deal("key"))
    firsts = (
        docs.groupBy(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("twice"), "text").alias("b"))
        .agg(F.min("key").alias("key"))
        .select("key")
        .distinct()
    )
    blank = {"row": "int", "shard": "int", "bits": "binary", "key": "long", "at": "int"}

    def notes(kind: str, rows: DataFrame) -> DataFrame:
        own = [c if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()]
        block = "block" if "block" in rows.columns else deal("key").alias("block")
        return rows.select(block, F.lit(kind).alias("kind"), *own)

    by_block = docs.groupBy("block")
    told = notes("first", firsts)
    sketch = by_block.cogroup(told.groupBy("block")).applyInArrow(_sketcher(size, anchor, shards), _DDL["sketch"])
    flags = sketch.groupBy("shard", "row").applyInArrow(_merge, _DDL["flags"])
    told = told.unionByName(notes("flags", flags))
    suspects = by_block.cogroup(told.groupBy("block")).applyInArrow(_counter(size, anchor, shards), _DDL["suspects"])
    earliest = (
        suspects.groupBy("h1", "h2").agg(F.min(F.struct("key", "at")).alias("e")).select("e.key", "e.at")
    )
    told = told.unionByName(notes("earliest", earliest))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(_remover(size, anchor, shards), _DDL["kept"])
