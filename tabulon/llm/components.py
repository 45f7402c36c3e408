"""Connected components by alternating stars, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every end of ``edges(a, b)``; the root is the component's least node.

    Large star ties every larger neighbour to a node's least neighbour, small
    star every smaller one; the forest flattens in about log(diameter) rounds.
    Minima are combined before shuffling, and the joins that follow
    are plain equi-joins, whose hot keys Spark splits at run time. A forest that
    still changes after ``rounds`` raises, as its roots would be wrong.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        e = written(tied.where("a <> b").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"Components are not settled after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
