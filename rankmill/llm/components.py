"""Connected components over an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import discard, spread_join, written


def _lowest(edges: DataFrame) -> DataFrame:
    """(x, m, rows): the smallest of each x's neighbours and of x itself, and how many neighbours it has."""
    return written(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("rows")), "lowest")


def _digest(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.bit_xor(F.xxhash64("y", "x"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges, itself included.

    Star contraction: every node that has a smaller neighbour points its larger neighbours and itself at the smallest
    one (large star), then the same towards smaller ones (small star). Rounds grow with the logarithm of the longest
    path. A node with many neighbours is spread over tasks. Each round is a written table, so no round depends on files
    of a lost executor; the one before is deleted.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = written(e.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    state = _digest(e)
    while True:
        both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = _lowest(both)
        large = spread_join(both, low, ["x"], "rows", "y").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = written(large, "large")
        least = _lowest(large)
        new = spread_join(large, least, ["x"], "rows", "y").select(
            F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("p")
        ).select("p.*").where("x <> y").distinct()
        new = written(new, "edges")
        discard(e, low, large, least)
        e, old, state = new, state, _digest(new)
        if state == old:
            break
    own = e.groupBy("x").agg(F.min("y").alias("component")).withColumnRenamed("x", "node")
    roots = e.select(F.col("y").alias("node")).distinct().join(own.select("node"), "node", "left_anti")
    return own.union(roots.select("node", F.col("node").alias("component")))
