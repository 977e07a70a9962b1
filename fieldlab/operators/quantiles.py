"""Exact order statistics of large groups.

The built-in exact percentile gathers all values of a group in one task. Here each pass counts values in `bins` even bins between
the ends of a bracket, and the bin that holds the wanted rank becomes the next bracket. A pass returns one row per target; a
bracket shrinks until its ends are equal, so ties end the search at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def refine(locate: Callable[[dict], dict], targets: dict) -> dict:
    """Narrow brackets until each is a single value.

    targets: id -> (rank inside the bracket, lo, hi); `locate` gives the next bracket of every open target.
    """
    found = {}
    while targets:
        for t in [t for t, (_, lo, hi) in targets.items() if hi - lo <= 1e-13 * max(abs(lo), abs(hi))]:
            found[t] = targets.pop(t)[1]
        if targets:
            closer = locate(targets)
            if set(closer) != set(targets):
                raise ValueError(f"rank beyond the data: {set(targets) - set(closer)}")
            targets = closer
    return found


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1))


def held_bins(counts: DataFrame, target: Sequence[str], rank: str) -> DataFrame:
    """The bin of each target that holds its rank, from rows (target, rank, bin, n, lo, hi): (target, left, n, lo, hi).

    A window holds the bins of one target; one row per target comes back.
    """
    upto = F.sum("n").over(W.partitionBy(*target).orderBy("bin"))
    left = F.col(rank) - (F.col("_upto") - F.col("n"))
    held = counts.withColumn("_upto", upto).withColumn("left", left).where((F.col("left") >= 0) & (F.col(rank) < F.col("_upto")))
    return held.select(*target, "left", "n", "lo", "hi")


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Callable[[int], list[int]], bins: int = 8192) -> dict:
    """{(group values, rank): value} for the ranks `ranks(n)` of each group. Groups are few (variables, sources).

    `df` is read once per pass, commonly three times; materialize it when it is costly.
    """
    data = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    finite = F.abs("_v") < math.inf
    spans = data.groupBy(*by).agg(
        F.count("_v").alias("n"), F.count_if(F.col("_v") == -math.inf).alias("below"), F.count_if(finite).alias("inside"),
        F.min(F.when(finite, F.col("_v"))).alias("lo"), F.max(F.when(finite, F.col("_v"))).alias("hi"),
    ).collect()
    targets, ends = {}, {}  # infinities are ranks below and above the bracket
    for r in spans:
        group = tuple(r[c] for c in by)
        for k in set(ranks(r["n"])):
            inside = k - r["below"]
            if 0 <= inside < r["inside"]:
                targets[(group, k)] = (inside, r["lo"], r["hi"])
            else:
                ends[(group, k)] = math.copysign(math.inf, inside)
    schema = data.select(*by).schema.add("_rank", "long").add("_in", "long").add("_lo", "double").add("_hi", "double")

    def locate(open_targets: dict) -> dict:
        rows = [(*group, k, inside, lo, hi) for (group, k), (inside, lo, hi) in open_targets.items()]
        brackets = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # one row per open target
        hits = data.join(brackets, list(by)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = hits.groupBy(*by, "_rank", "_in", bin_of(F.col("_v"), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(
            F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        )
        held = held_bins(counts, [*by, "_rank"], "_in").collect()  # one row per open target
        return {(tuple(r[c] for c in by), r["_rank"]): (r["left"], r["lo"], r["hi"]) for r in held}

    values = refine(locate, targets) | ends
    sizes = {tuple(r[c] for c in by): r["n"] for r in spans}
    return {"sizes": sizes, "values": values}


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by, prob, quantile) with linear interpolation between neighbours."""

    def ranks(n: int) -> list[int]:
        return [k for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    got = order_statistics(df, by, value, ranks)
    rows = []
    for group, n in got["sizes"].items():
        for p in probs:
            at = p * (n - 1)
            lo, hi = got["values"][(group, math.floor(at))], got["values"][(group, math.ceil(at))]
            part = at - math.floor(at)
            rows.append((*group, float(p), lo if part == 0 or lo == hi else lo + (hi - lo) * part))
    schema = df.select(*by).schema.add("prob", "double").add("quantile", "double")
    return df.sparkSession.createDataFrame(rows, schema)


def display_limits(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, symmetric: Column | None = None) -> DataFrame:
    """(by, lo, hi): percentile limits; rows for which `symmetric` holds get +- the larger magnitude."""
    q = exact_quantiles(df, by, value, [low, high])
    ends = q.groupBy(*by).agg(F.min("quantile").alias("lo"), F.max("quantile").alias("hi"))
    if symmetric is None:
        return ends
    reach = F.greatest(F.abs("lo"), F.abs("hi"))
    return ends.select(*by, F.when(symmetric, -reach).otherwise(F.col("lo")).alias("lo"), F.when(symmetric, reach).otherwise(F.col("hi")).alias("hi"))


def lower_median(df: DataFrame, by: Sequence[str], value: str) -> dict:
    got = order_statistics(df, by, value, lambda n: [(n - 1) // 2])
    return {group: got["values"][(group, (n - 1) // 2)] for group, n in got["sizes"].items()}
