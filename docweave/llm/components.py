"""Connected components of links between 64-bit nodes, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    ``links`` has columns ``u`` and ``v``; self links and repeats are
    allowed. Stars are linked by turns to the smallest neighbour, which ends
    after a number of rounds about the logarithm of the longest path. Smallest
    neighbours are found by partial aggregation; the joins have plain
    shuffles on both sides, so that Spark can split a hub's rows. Each round
    is cut into the shared folder. Nodes without links don't appear.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m")))
        # large star: greater neighbours go to the smallest one
        large = cut(both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: smaller neighbours and the node itself go to the smallest one
        least = cut(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")))
        met = large.join(least, F.col("u") == F.col("n")).select("u", "v", "m")
        edges = cut(met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
