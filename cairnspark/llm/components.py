"""Connected components by alternating star contraction, over edges that may not fit any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import forget, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select("m", "u"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root is the smallest node reachable. Each round is written out, so
    a lost executor costs that round only, and replaces the one before; the number of rounds grows with the logarithm of
    the nodes. A node with very many neighbours is one key of a sort-merge join, which adaptive execution splits."""
    e = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        before, e = e, stored(_small_star(_large_star(e)), "edges")
        forget(before)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a"), F.col("a"))).distinct()
        seen = now
    raise RuntimeError(f"components still changed after {most_rounds} rounds")
