"""Connected classes by alternating stars.

Each turn replaces the links by fewer or equally many that keep every class connected: the larger neighbours of a node are tied to the
smallest one around it (large star), then the smaller neighbours (small star). It ends when every class is one star around its smallest
member. So a turn never has more links than the first, hubs are joins that adaptive execution can split, and the number of turns grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.reuse import stored


def _least(pairs: DataFrame) -> DataFrame:
    """(a, least) of pairs(a, b). Written, so that the join with it is dealt anew and can be split."""
    return stored(pairs.groupBy("a").agg(F.min("b").alias("least")))


def _summary(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38, 0)))")).first())


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in links(low, high) of long ids: the smallest id of its class."""
    pairs = stored(links.where("low != high").select(F.greatest("low", "high").alias("a"), F.least("low", "high").alias("b")).distinct())
    seen = _summary(pairs)
    while True:
        both = pairs.union(pairs.select("b", "a"))
        around = both.join(_least(both), "a")
        large = around.where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        large = stored(large.distinct())
        centre = _least(large)
        below = large.join(centre, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        pairs = stored(below.union(centre.select("a", F.col("least").alias("b"))).distinct())
        now = _summary(pairs)
        if now == seen:
            heads = pairs.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("root")).union(heads)
        seen = now
