"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation to the least neighbour (combined before the
shuffle) and a join; a node with very many neighbours is one key whose rows
the joins can split.  Tables between steps are written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.llm.runtime import forget, stored


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, or itself where it is less."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, *, u: str = "u", v: str = "v", max_steps: int = 60) -> DataFrame:
    """(node, label) for every node of an edge; the label is the least node of its component."""
    now = stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_steps):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = large.join(_least(large), "u")
        down = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        last, now = now, stored(down, "edges")
        forget(last)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
