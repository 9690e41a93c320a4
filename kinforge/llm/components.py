"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.frames import checkpointed
from kinforge.operators.joins import split_join

#: Rounds are logarithmic in the longest path; this only stops a faulty run.
MAX_ROUNDS = 60


def _equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge tables without repeats hold the same rows."""
    both = a.select("u", "v", F.lit(1).alias("n")).unionByName(b.select("u", "v", F.lit(-1).alias("n")))
    return both.groupBy("u", "v").agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node
    that it reaches.

    Each round links neighbours to the smallest one near them; the edge table
    stays about as large as it was and is written to the checkpoint folder
    after each round, so a lost executor costs one round.  The rounds end when one
    changes no row; only that answer comes to the driver.  The smallest
    neighbour is an aggregate (summed before the shuffle) that is joined back, so
    a node with very many edges is split as any skewed join is."""
    edges = checkpointed(
        edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(0 if edges.isEmpty() else MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both.filter("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = split_join(large, low, ["u"])
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, checkpointed(small.distinct())
        if _equal(before, edges):
            break
    else:
        if not edges.isEmpty():
            raise RuntimeError("the components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
