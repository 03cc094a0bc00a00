"""Connected components by alternating stars: every edge moves towards the least node it can see until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node that can be reached.

    Loops, repeated edges and either direction are fine; edges with a null end are left out. Each round is two aggregations and
    joins over the edges, whatever the degree of a node; the edges of each round are written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == before or not seen["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
        before = seen
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(a.alias("at"), F.least("a", "low").alias("low"))
        large = both.join(low, a == F.col("at")).where(b > a).select(b.alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(a.alias("at"), "low")
        small = large.join(low, a == F.col("at")).where(b != F.col("low")).select(b.alias("a"), F.col("low").alias("b"))
        edges = cut(small.union(low.select("at", "low")).distinct())
