"""Connected components of links, by alternating large and small stars.

Every round links each node to the smallest of its neighbourhood; the number of
rounds follows the logarithm of the number of nodes. Rounds are written to the
shared folder, so a lost executor costs no more than the round it was in, and
each round deletes the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links the larger (or all smaller) neighbours of each node to its smallest one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node each linked node can reach: node, component.

    Nodes are of any type that sorts. Links to itself and nulls count nothing; no
    links give no rows. The result is stored(); discard() deletes it.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        last, edges = edges, stored(_star(_star(edges, True), False), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    near = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = near.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.stored_at = edges.stored_at
    return out
