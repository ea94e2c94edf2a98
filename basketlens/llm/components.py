"""Connected components of a graph given as links, as repeated joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import dropped, settled


def _larger(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _smaller(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of those neighbours."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached, for every node with a link.

    ``links`` has columns a and b of one type. Large-star and small-star rounds make each component a
    star around its least node, in about log(n) rounds; each round is a written table, so that no
    lineage grows and a lost executor costs one round; the table of the round before is dropped. Only a count and a checksum of the links come to the driver.
    """
    now, before = settled(links.where("a <> b").select("a", "b").distinct()), None
    while (state := _state(now)) != before:
        after = settled(_smaller(_larger(now)))
        dropped(now)
        now, before = after, state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
