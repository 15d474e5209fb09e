"""Connected components of an undirected link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a hub's links stay spread over tasks (adaptive execution splits
the join) and nothing is gathered. Each step is written to the shared folder. It ends when no link changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import materialize, release


def _large(e: DataFrame) -> DataFrame:
    """For each node u: link every larger neighbour to the least of u and its neighbours."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """For each node u (links point to smaller nodes): link u and its smaller neighbours to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node that links reach.

    Self-links and nulls are ignored, repeated links count once, an empty table gives an empty one.
    """
    spark = edges.sparkSession
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = materialize(e, "links")
    state = None
    while True:
        nxt, new = materialize(_small(_large(e)), "links")
        r = nxt.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30))).alias("s")).first()
        release(spark, path)
        e, path = nxt, new
        if tuple(r) == state:
            break
        state = tuple(r)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
