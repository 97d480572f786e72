"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is a partial-aggregated minimum by node and a join of the edges with it: no neighbourhood is ever gathered, and
a hub's rows can be split by the join. Every round's edges are a table in the shared folder, so lineage stays short and a
lost executor costs one round's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plinth.session import forget, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: link a node's greater neighbours to its least one, itself counted. small: link its lesser ones so. Here edges
    are (a, b) with a > b."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return linked.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), longs without nulls: the least node that can be reached.
    Loops and repeated edges do no harm; no edges give no rows."""
    spark = edges.sparkSession
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    last = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            break
        large = staged(_star(now, True), "large")
        small = staged(_star(large, False), "small")
        forget(spark, now, large)
        last, now = mark, small
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
