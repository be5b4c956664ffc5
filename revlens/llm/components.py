"""Connected components of an edge table by alternating large and small stars.

Every round is two groupings and two joins on the edge table; the edges of a
round are written to the shared checkpoint folder and those of the round
before are deleted. No node, edge or component reaches the driver: it sees a
count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the undirected edges ``(u, v)``
    that is not the smallest of its component; ``label`` is that smallest
    node. Loops, repeated edges and both directions are allowed."""
    now = written(edges.where("u <> v").select(
        F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        near = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        following = written(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(following)
        discard(now)
        now = following
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
