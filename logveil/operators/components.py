"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.scratch import only_result, stage


def _downhill(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, loops removed."""
    return (
        edges.where("a <> b")
        .select("tenant_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _point_to_lowest(edges: DataFrame) -> DataFrame:
    """Connect every node's larger neighbours to its lowest neighbour or itself."""
    both = edges.unionByName(edges.select("tenant_id", F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("tenant_id", "a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return _downhill(
        both.where("b > a")
        .join(low, ["tenant_id", "a"])
        .select("tenant_id", F.col("b").alias("a"), F.col("low").alias("b"))
    )


def _point_below_to_lowest(edges: DataFrame) -> DataFrame:
    """Connect every node and its smaller neighbours to the lowest of them."""
    low = edges.groupBy("tenant_id", "a").agg(F.min("b").alias("low"))
    others = edges.join(low, ["tenant_id", "a"]).select(
        "tenant_id", F.col("b").alias("a"), F.col("low").alias("b")
    )
    return _downhill(others.unionByName(low.withColumnRenamed("low", "b")))


def _are_stars(edges: DataFrame) -> bool:
    """Every node hangs on one other node, and none that others hang on hangs itself."""
    ends = edges.select("tenant_id", F.col("a").alias("node"), F.lit(1).alias("hangs")).unionByName(
        edges.select("tenant_id", F.col("b").alias("node"), F.lit(0).alias("hangs"))
    )
    return (
        ends.groupBy("tenant_id", "node")
        .agg(F.sum("hangs").alias("up"), F.count_if(F.col("hangs") == 0).alias("down"))
        .where("up > 1 or (up = 1 and down > 0)")
        .isEmpty()
    )


@only_result("components")
def connected_components(edges: DataFrame) -> DataFrame:
    """(tenant_id, node, root) with the lowest node of each component as its root.

    Alternates two star contractions until the edges are stars. Each step is a grouped
    minimum and a join against it, so a node with very many neighbours is never gathered in
    one place. Nodes without an edge do not appear.
    """
    stars = stage(_downhill(edges), "edges")
    while not _are_stars(stars):
        stars = stage(_point_below_to_lowest(_point_to_lowest(stars)), "edges")
    member = stars.select("tenant_id", F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select("tenant_id", F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return member.unionByName(roots)
