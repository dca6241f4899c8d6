"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progscan.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node points its larger neighbours to the smallest node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of an edge table (a, b) but the smallest of its component, with that smallest node.

    Edges may repeat and have any direction; loops are ignored. Large-star and
    small-star rounds turn every component into a star; the number of rounds
    grows with the logarithm of the longest path. Each round is written to the
    shared folder, so its lineage is one read.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "components")
    state = None
    while True:
        edges = written(_small_star(_large_star(edges)).distinct(), "components")
        # bit_xor and count of all edges: unchanged only if the stars are final
        now = edges.select(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == state:
            return edges
        state = now
