"""Connected components over edge lists, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged


def stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a: then each b is the centre of a whole component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.max("centre").alias("centre"))
    return not seen.where("leaves > 1 or (leaves > 0 and centre > 0)").limit(1).count()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps, each one shuffle with map-side minima, until all
    that is left is stars, which takes a number of rounds logarithmic in the longest path. Every round
    is written to the shared folder, so neither lineage nor lost executors hurt. Null ends and loops
    are ignored, repeated edges count once; an empty input gives an empty result.
    """
    current = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    for _ in range(most_rounds):
        if stars(current):
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
        both = current.union(current.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(lower.select("a", F.col("low").alias("b")))
        current = staged(small.distinct(), "component-edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
