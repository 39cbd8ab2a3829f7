"""Connected components of an edge table, for graphs of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweft.llm.tables import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): each node of the edges (a, b) with the smallest node it is linked to.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then
    its smaller ones, to its smallest neighbour. The number of rounds grows with the
    logarithm of the longest path. Smallest neighbours are found by an aggregation that
    combines before the shuffle, and are stored before they are joined back: Spark can then
    split the edges of a node that has most of them among tasks, which it cannot do while the
    join's other side comes straight from an aggregate on the same key.
    """
    links = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stored(large, name)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        links = stored(small.select("e.*").where("a != b").distinct(), name)
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
