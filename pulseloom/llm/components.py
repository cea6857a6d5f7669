"""Connected components of a large graph by alternating star contractions.

Each round turns every node's larger neighbours towards the node's least neighbour (large star), then does the same with
its smaller ones (small star).  Rounds end when nothing moves; then every node hangs on the least node of its component.
Edges are written to the shared folder after each step, and the driver gets two numbers a round.  A node with very many
neighbours is read by joins that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.session import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (least node of its component) for every node of ``edges`` (``a``, ``b``).

    Edges from a node to itself are left out, and with them nodes that have no other edge.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = materialise(
            both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
