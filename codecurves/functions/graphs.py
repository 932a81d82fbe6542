"""Connected components, and joins with nodes that have very many edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored

#: Parts that the edges of one node are dealt to in a star round, so that a hub's edges are several tasks' work.
STAR_SALTS = 8


def salted(nodes: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(STAR_SALTS - 1))))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star rounds; returns (node, label), label the
    smallest node reachable.

    Each round is two aggregations (partial before the shuffle) and joins on the edge list, whose rows are salted so that a node with very
    many neighbours is several tasks' work. Rounds are written to shared storage, and the rounds before deleted; nothing is collected but
    a count and a checksum."""
    live = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        # each edge (u > v) goes from v, which sends u on to the least it knows
        least = live.select(F.col("v").alias("x"), F.col("v").alias("y")).unionByName(live.select(F.col("u").alias("x"), F.col("v").alias("y"))).groupBy("x").agg(F.min("y").alias("m"))
        by_low = live.select("u", F.col("v").alias("x"), salt_of("u")).join(salted(least), ["x", "salt"])
        large = stored(by_low.select("u", F.col("m").alias("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        by_high = large.select("u", "v", salt_of("v")).join(salted(low), ["u", "salt"])
        small = by_high.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, live = live, stored(small.distinct(), "small-star")
        now = live.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        discard(last, large)
        if now == before:
            break
        before = now
    return live.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(live.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label")))


def salt_of(column: str) -> Column:
    return F.pmod(F.hash(column), F.lit(STAR_SALTS)).alias("salt")
