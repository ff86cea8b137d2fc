"""Connected components of a distributed edge list.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every step is a min aggregate, which
combines map-side, and a join back, which AQE splits where a star's centre is
hot.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): every node that has an edge and the smallest node that it
    reaches.  ``edges`` has columns a and b; self-loops and repeats are allowed."""
    now = materialize(_star(edges.where("a <> b")), "edges")
    before = _signature(now)
    for _ in range(max_rounds if before[0] else 0):
        now = materialize(_small(_large(now)), "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not converge")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _star(edges: DataFrame) -> DataFrame:
    """Distinct edges with the larger node first."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _signature(edges: DataFrame) -> tuple[int, object]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))  # a < v
    return larger.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
