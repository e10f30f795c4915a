"""Near-duplicate embeddings of one label: 8-bit tile products with error bounds.

Each vector u of length one is quantised to 8-bit codes q with its own scale s, and the length e of
u - s q, its quantisation error, is kept. Then |u v - (s_u q_u)(s_v q_v)| <= e_u + (1 + e_u) e_v, so
a product of codes says for most pairs on which side of the threshold they are. Only pairs whose interval
holds the threshold are computed again in double precision from the given components. Code products of
a tile are one matrix product (of whole numbers below 2**24, which single precision holds exactly).

Exact copies are folded first and count with their number. A label's vectors are dealt to tiles of at
most `TILE` components by a hash, a task gets two tiles, and sends per vector the sum of its links and
one link of a spanning forest: never a pair inside a group. Components are joined over written tables.
The pairs of a label are all compared, so work grows with the square of the largest label (a tile's
memory does not); a hot label is more tiles, not a larger one.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without
a label, link with nothing; vectors of different length do not link; repeated rows are vectors of their
own and link; a null vec_id comes before all others as key (its component_id is then the least long) and
stays null as vec_id; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logveil.llm.simhash_dedup import Forest
from logveil.operators.components import connected_components
from logveil.scratch import stage

THRESHOLD = 0.98
TILE, FEW, SPREAD = 1 << 23, 2048, 8
SUB, PAIRS = 1024, 1 << 16
EXACT = 1 << 10  # components whose code products add up below 2**24
SLACK = 1e-9
_NO_ID = -(1 << 63)
CLASS = ["label", "h1", "h2"]
NODE = ["key", *CLASS]  # of the copy with the least key; vec_ids may repeat


class Coded:
    """Vectors with their codes, scales, errors and (power-of-two scaled) given components."""

    def __init__(self, given: np.ndarray) -> None:
        top = np.abs(given).max(axis=1, keepdims=True)
        self.given = np.ldexp(given, -np.frexp(top)[1])  # exact, and no square can overflow
        self.length = np.sqrt((self.given * self.given).sum(axis=1))
        unit = self.given / self.length[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / self.scale[:, None])
        gap = unit - codes * self.scale[:, None]
        self.error = np.sqrt((gap * gap).sum(axis=1)) + SLACK
        self.codes = codes.astype(np.int8)

    def products(self, other: Coded) -> np.ndarray:
        out = np.zeros((len(self.codes), len(other.codes)), np.float64 if self.codes.shape[1] > EXACT else np.float32)
        for k in range(0, self.codes.shape[1], EXACT):
            a, b = (x.codes[:, k : k + EXACT].astype(np.float32) for x in (self, other))
            out += a @ b.T
        return out

    def cosine(self, i: np.ndarray, other: Coded, j: np.ndarray) -> np.ndarray:
        dot = [
            np.einsum("ij,ij->i", self.given[i[k : k + PAIRS]], other.given[j[k : k + PAIRS]])
            for k in range(0, len(i), PAIRS)
        ]
        return np.concatenate([np.zeros(0), *dot]) / (self.length[i] * other.length[j])


def linked(a: Coded, b: Coded, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j, how many were computed again) of the pairs at or above the threshold."""
    product = a.products(b)
    near = product * (a.scale.astype(np.float32)[:, None] * b.scale.astype(np.float32)[None, :])
    widest = (1 + a.error.max()) * b.error.max() + a.error.max()
    i, j = np.nonzero(near >= threshold - widest - 1e-4)  # 1e-4: what single precision may lose here
    about = product[i, j].astype(np.float64) * a.scale[i] * b.scale[j]
    bound = a.error[i] + (1 + a.error[i]) * b.error[j]
    sure = about - bound >= threshold
    open_ = np.flatnonzero(~sure & (about + bound >= threshold))
    sure[open_] = a.cosine(i[open_], b, j[open_]) >= threshold
    return i[sure], j[sure], len(open_)


def _matcher(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        tile = table["tile"].to_numpy()
        node, weight = table["node"].combine_chunks(), table["weight"].to_numpy()
        order = np.argsort(tile, kind="stable")
        ends = [0, int((tile == tile.min()).sum()), len(tile)]
        alone = table["i"][0].as_py() == table["j"][0].as_py()
        vectors = table["vec"].combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(tile), -1)

        def cut(a: int, b: int) -> list[tuple[np.ndarray, Coded]]:
            parts = [order[k : min(k + SUB, b)] for k in range(a, b, SUB)]
            return [(rows, Coded(flat[rows].astype(np.float64))) for rows in parts]

        forest, count = Forest(len(tile)), np.zeros(len(tile), np.int64)
        left = cut(ends[0], ends[1])
        right = left if alone else cut(ends[1], ends[2])
        for x, (rows_a, a) in enumerate(left):
            for rows_b, b in right[x:] if alone else right:
                i, j, _ = linked(a, b, threshold)
                if a is b:
                    i, j = i[i < j], j[i < j]
                i, j = rows_a[i], rows_b[j]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                ends_of = forest.tops(i), forest.tops(j)
                apart = ends_of[0] != ends_of[1]
                for pair in np.unique(ends_of[0][apart] * len(tile) + ends_of[1][apart]).tolist():
                    forest.join(np.array(divmod(pair, len(tile))))
        used = np.flatnonzero(count)
        return pa.table({"node": node.take(pa.array(used)), "n": count[used], "top": node.take(pa.array(forest.tops(used)))})

    return run


def _sound(vec: Column) -> Column:
    """No null or non-finite component, and one that is not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", tile: int = TILE, few: int = FEW
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    vec = F.col(vector)
    key = F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID))
    usable = F.col("label").isNotNull() & _sound(vec)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), key.alias("key"), "label", vec.alias("vec"), usable.alias("usable")
    )
    hashed = stage(
        rows.select(
            "vec_id", "key", "label", "usable", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")
        ),
        "hashes",
    )
    copies = stage(
        hashed.where("usable").groupBy(*CLASS).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")), "copies"
    )
    found = stage(_tile_links(_one_per_class(rows, copies), threshold, tile, few), "links")
    roots = connected_components(
        found.where("node <> top").select(F.lit("").alias("tenant_id"), F.col("node").alias("a"), F.col("top").alias("b"))
    ).select("node", "root")
    sums = found.groupBy("node").agg(F.sum("n").alias("n"))
    classes = (
        copies.withColumn("node", F.struct(*NODE))
        .join(sums, "node", "left")
        .join(roots, "node", "left")
        .select(
            *CLASS,
            (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node")["key"].alias("component_id"),
        )
    )
    alone = hashed.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept")
    )
    return (
        hashed.where("usable")
        .join(classes, CLASS)
        .select("vec_id", "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))
        .unionByName(alone)
    )


def _one_per_class(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(label, node, weight, vec, dims): of rows that share key and vector one is taken."""
    own = rows.where("usable").withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    return (
        own.join(copies, [*CLASS, "key"])
        .dropDuplicates([*CLASS, "key"])
        .select("label", F.struct(*NODE).alias("node"), "weight", "vec", F.size("vec").alias("dims"))
    )


def _tile_links(distinct: DataFrame, threshold: float, tile: int, few: int) -> DataFrame:
    """(node, n, top): per task, each vector's weighted number of links and the top of its tree."""
    distinct = stage(distinct, "distinct")
    number = F.col("n") * F.col("dims") / tile
    tiles = F.greatest(F.ceil(number), F.least(F.lit(SPREAD), F.ceil(F.col("n") / few))).cast("int")
    sizes = distinct.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    met = (
        distinct.join(sizes.select("label", "dims", tiles.alias("tiles")), ["label", "dims"])
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "label", "dims", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
            "tile", "node", "weight", "vec",
        )
    )
    node = distinct.schema["node"].dataType
    schema = T.StructType().add("node", node).add("n", T.LongType()).add("top", node)
    return met.groupBy("label", "dims", "i", "j").applyInArrow(_matcher(threshold), schema)
