"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the smallest node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node.

    Nodes are longs.  Roots aren't listed for nodes without an edge.  Every round
    is written to the shared folder; the driver sees a count and a checksum.  The
    number of rounds is logarithmic in the size of a component.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        now = written(_small_star(_large_star(now)), "edges")
        was, seen = seen, _digest(now)
        if was == seen:
            break
    star = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.union(star.select(F.col("root").alias("node"), "root").distinct())
