"""SimHash near-duplicates: fingerprints, and BK-trees that link those within a few bits.

Fingerprints are made in place, from the whole text. Equal ones are folded by a grouping, and
their distinct values are linked by BK-trees: children are keyed by their Hamming distance to the
parent, and a search follows only the edges within the radius of its own distance.

One tree over all fingerprints would have to reach every task and would grow with the data, and a
search in it would visit a share of all nodes. So trees belong to *shards*: the 64 bits are cut into
`radius + 2` blocks, and two fingerprints within the radius agree in at least two of them, so they
meet in the shard of those two blocks and their values. Shards are built and searched where they
are shuffled to, never broadcast. A shard of more than `SHARD` fingerprints is cut into parts, and a
task gets two of them: the tree of one and the searches of the other. A task sends a spanning forest
of its links (fewer than it has members), never all pairs, and components are joined by star
contraction over written tables.

Defined cases: a null or wordless text has fingerprint zero; an empty table gives an empty result;
repeated rows each get their row; a null doc_id comes before all others as key and stays null
as doc_id (its component_id is then the least long). Other columns are ignored, or kept by `one_of_each`,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.llm.words import BLANKS, Words, words, released
from logveil.llm.rows import packed
from logveil.operators.components import connected_components
from logveil.scratch import stage

RADIUS, SHARD = 3, 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# ------------------------------------------------------------------ fingerprints


def _spaced(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each begins and ends there."""
    length = w.end - w.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    shift = np.repeat(start - w.start, length)
    source = np.flatnonzero(~BLANKS[w.bytes])
    out[source + shift] = w.bytes[source]
    return out.tobytes(), start, end


def _fingerprints(w: Words, shingle: int) -> np.ndarray:
    data, start, end = _spaced(w)
    n = np.where(w.counts >= shingle, w.counts - shingle + 1, np.minimum(w.counts, 1))
    owner = np.repeat(np.arange(len(w)), n)
    first = w.cut[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + shingle, w.cut[owner + 1]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], 42) for a, b in zip(start[first].tolist(), end[last].tolist())),
        np.uint64,
        len(owner),
    )
    result = np.zeros(len(w), np.uint64)
    for k in range(8):  # byte by byte from the lowest: how often each value occurs, times its bits
        byte = (hashes >> np.uint64(8 * k)).astype(np.uint8)
        often = np.bincount(owner * 256 + byte, minlength=256 * len(w)).reshape(len(w), 256)
        ones = 2 * (often @ _BITS) > n[:, None]
        result |= np.packbits(ones, axis=1)[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return result


def _fingerprinter(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch["text"], lower=True):
                found = _fingerprints(w, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][w.first : w.first + len(w)], pa.array(found)], ["doc_id", "fp"]
                )

    return run


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(released(_fingerprinter(shingle)), "doc_id bigint, fp bigint")


# ------------------------------------------------------------------ trees


class Tree:
    """A BK-tree over distinct 64-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values.view(np.uint64)
        plain = self.values.tolist()
        self.children: list[dict[int, int]] = [{} for _ in plain]
        for i in range(1, len(plain)):
            at = 0
            while True:
                below = self.children[at]
                d = (plain[at] ^ plain[i]).bit_count()
                if d not in below:
                    below[d] = i
                    break
                at = below[d]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, queries within the radius of it); all queries walk down together."""
        asked = queries.view(np.uint64)
        open_nodes = [(0, np.arange(len(asked)))]
        while open_nodes:
            node, some = open_nodes.pop()
            d = np.bitwise_count(asked[some] ^ self.values[node]).astype(np.int64)
            yield node, some[d <= radius]
            for edge, child in self.children[node].items():
                reach = some[np.abs(d - edge) <= radius]
                if len(reach):
                    open_nodes.append((child, reach))


class Forest:
    """Sets of linked places, joined as links are found."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def tops(self, places: np.ndarray) -> np.ndarray:
        top = self.up[places]
        while True:
            higher = self.up[top]
            if np.array_equal(higher, top):
                self.up[places] = top
                return top
            top = higher

    def join(self, places: np.ndarray) -> None:
        tops = np.unique(self.tops(places))
        self.up[tops] = tops[0]


def _links(fp: np.ndarray, node: np.ndarray, part: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one task: within one part, or between the tree of one and the other."""
    order = np.argsort(node, kind="stable")
    fp, node, part = fp[order], node[order], part[order]
    in_tree = part == part.min()
    tree = np.flatnonzero(in_tree)
    asking = tree if in_tree.all() else np.flatnonzero(~in_tree)
    forest = Forest(len(fp))
    for at, found in Tree(fp[tree]).near(fp[asking], radius):
        if len(found):
            forest.join(np.append(asking[found], tree[at]))
    top = forest.tops(np.arange(len(fp)))
    joined = top != np.arange(len(fp))
    return node[joined], node[top[joined]]


_SHARD_KEY = ["a", "b", "bits", "i", "j"]


def _linker(radius: int):
    """Reads rows sorted by shard and links each shard as soon as it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            done, kept = linked(table, last=False)
            yield from done
        if kept is not None:
            yield from linked(kept, last=True)[0]

    def linked(table: pa.Table, last: bool):
        columns = {c: table[c].to_numpy() for c in table.column_names}
        n = len(table)
        new = np.ones(n, bool)
        if n:
            new[1:] = np.logical_or.reduce([columns[c][1:] != columns[c][:-1] for c in _SHARD_KEY])
        cut = np.append(np.flatnonzero(new), n)
        if not last:
            cut = cut[:-1]
        found = [
            _links(*(columns[c][x:y] for c in ("fp", "node", "part")), radius)
            for x, y in zip(cut[:-1], cut[1:])
            if y - x > 1
        ]
        out = [np.concatenate(side) if found else np.zeros(0, np.int64) for side in (zip(*found) if found else ((), ()))]
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])
        return [batch], table.slice(int(cut[-1]) if len(cut) else 0)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links between nodes that span every set of (fp, node) rows linked within the radius."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (y - x)) - 1) << x for x, y in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    shards = [
        F.struct(
            F.lit(x).cast("int").alias("a"),
            F.lit(y).cast("int").alias("b"),
            F.col("fp").bitwiseAND(F.lit(signed(masks[x] | masks[y])).cast("long")).alias("bits"),
        )
        for x, y in combinations(range(blocks), 2)
    ]
    rows = distinct.select("fp", "node", F.explode(F.array(*shards)).alias("s")).select("s.*", "fp", "node")
    sizes = rows.groupBy("a", "b", "bits").count()
    large = stage(
        sizes.where(F.col("count") > shard).select(
            "a", "b", "bits", F.ceil(F.col("count") / shard).cast("int").alias("parts")
        ),
        "shards",
    )
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = (
        rows.join(large, ["a", "b", "bits"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "a", "b", "bits",
            F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
            "part", "fp", "node",
        )
    )
    return (
        met.repartition(*_SHARD_KEY)
        .sortWithinPartitions(*_SHARD_KEY)
        .mapInArrow(released(_linker(radius)), "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(documents: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    made = stage(fingerprints(documents, shingle), "fingerprints")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    distinct = stage(made.groupBy("fp").agg(F.min(key).alias("node")), "distinct")
    found = links(distinct, radius).select(F.lit("").alias("tenant_id"), "a", "b")
    roots = connected_components(found).select("node", "root")
    component = stage(
        distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")),
        "components",
    )
    return made.join(component, "fp").select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """The documents with the smallest doc_id of their component; equal rows of one id count once."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    found = near_duplicates(documents, shingle, radius)
    lowest = found.where(key == F.col("component_id")).select(key.alias("key")).distinct()
    same = Window.partitionBy("key", "h1", "h2").orderBy("key")
    text = F.col("text").cast("string")
    return (
        documents.select(
            key.alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), packed(documents)
        )
        .join(lowest, "key", "left_semi")
        .withColumn("copy", F.row_number().over(same))
        .where("copy = 1")
        .select("row.*")
    )
