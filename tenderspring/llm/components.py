"""Connected components of an edge table by alternating star rounds; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node it is connected with.

    Each round hangs every node's neighbours on the smallest of them (first those above the node, then those
    below), which keeps connectivity and shortens paths until each component is a star. Minima are combined
    before the shuffle, and the joins are on plain keys, so that Spark can split a node with very many edges.
    Self-loops and repeated edges do no harm; a null end is ignored. No edges: no rows.
    """
    now = settle(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct(), "edges"
    )
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = settle(small.where("u > v").distinct(), "stars")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
