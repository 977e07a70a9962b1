"""Normalization statistics: absolute fields and lagged differences, per variable.

All statistics are unweighted population statistics in double precision. A standard deviation of at most 1e-8 counts as 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.arrays import let, moments_of
from fieldlab.functions.reuse import stored
from fieldlab.operators.pairing import prior_by_index
from fieldlab.operators.select import select_time_ranges

MIN_STD = 1e-8


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def safe_std(std: Column) -> Column:
    return F.when(std > MIN_STD, std).otherwise(1.0)


def field_stats(cells: DataFrame, kind: str = "abs", value: str = "value") -> DataFrame:
    """stats(variable, kind, mean, std, n). Missing values are skipped, as the partial aggregates run map-side."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    return cells.groupBy("variable").agg(
        F.avg(v).alias("mean"), safe_std(F.coalesce(F.stddev_pop(v), F.lit(0.0))).alias("std"), F.count(v).alias("n")
    ).withColumn("kind", F.lit(kind))


def snapshot_stats(snapshots: DataFrame, kind: str = "abs") -> DataFrame:
    """`field_stats` of snapshots without taking them apart: count, mean and spread of each array, then their union per variable."""
    values = F.filter(F.col("values"), lambda v: v.isNotNull() & ~F.isnan(v))
    moments = let(values, lambda a: F.struct(F.size(a).alias("n"), F.when(F.size(a) > 0, moments_of(a)).alias("m")))
    parts = stored(snapshots.select("variable", moments.alias("_p")).select("variable", "_p.n", "_p.m.mean", "_p.m.std"))
    whole = parts.groupBy("variable").agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    gap = F.col("mean") - F.col("_mean")
    out = parts.join(whole, "variable").groupBy("variable").agg(
        F.first("_mean").alias("mean"), F.sqrt(F.sum(F.col("n") * (F.col("std") * F.col("std") + gap * gap)) / F.first("_n")).alias("std"), F.first("_n").alias("n")
    )
    return out.select("variable", "mean", safe_std(F.coalesce("std", F.lit(0.0))).alias("std"), "n", F.lit(kind).alias("kind"))


def finite_stats(cells: DataFrame, ranges=None) -> DataFrame:
    """Statistics of the finite values only; raises when a selection is empty at run time."""
    kept = select_time_ranges(cells, ranges).where(is_finite(F.col("value").cast("double")))
    stats = field_stats(kept)
    return stats.withColumn("n", F.when(stats.n > 0, stats.n).otherwise(F.raise_error(F.lit("no finite values")).cast("bigint")))


def train_stats(cells: DataFrame, ranges, required: Sequence[str]) -> DataFrame:
    """Statistics over the train ranges for every required variable; an absent one gets mean 0 and std 1."""
    stats = field_stats(select_time_ranges(cells, ranges).where(F.col("variable").isin(list(required))))
    names = cells.sparkSession.createDataFrame([(v,) for v in required], "variable string")
    return names.join(stats, "variable", "left").select(
        "variable",
        F.lit("abs").alias("kind"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce("std", F.lit(1.0)).alias("std"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def diff_stats(cells: DataFrame, delta_steps: int) -> DataFrame:
    """Statistics of X_t - X_(t - delta), priors found by time index."""
    if delta_steps <= 0:
        raise ValueError("delta_steps must be positive")
    return pair_diff_stats(prior_by_index(cells, delta_steps))


def pair_diff_stats(pairs: DataFrame) -> DataFrame:
    """Statistics of value - prior_value of pairs that exist already."""
    return field_stats(pairs.withColumn("diff", F.col("value") - F.col("prior_value")), "diff", "diff")


def normalize(cells: DataFrame, stats: DataFrame, value: str = "value") -> DataFrame:
    """Z-score per variable, then missing to 0, so that a gap equals the mean. Statistics have one row per variable."""
    s = stats.select("variable", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    z = (F.col(value).cast("double") - F.col("_mean")) / safe_std(F.col("_std"))
    return cells.join(F.broadcast(s), "variable").withColumn(value, nan_to_zero(z)).drop("_mean", "_std")


def denormalize(cells: DataFrame, stats: DataFrame, value: str = "value") -> DataFrame:
    s = stats.select("variable", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return cells.join(F.broadcast(s), "variable").withColumn(value, F.col(value) * safe_std(F.col("_std")) + F.col("_mean")).drop("_mean", "_std")


def nan_to_zero(v: Column) -> Column:
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def add_missing_channels(cells: DataFrame, required: Sequence[str]) -> DataFrame:
    """Give every sample cell each required variable, with an explicit 0 where it is absent.

    Variables of a cell are gathered (at most one value per variable) and laid out again, so no join is needed.
    """
    cell = [c for c in cells.columns if c not in ("variable", "value")]
    wide = cells.where(F.col("variable").isin(list(required))).groupBy(*cell).agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in required]
    )
    filled = wide.select(*cell, *[nan_to_zero(F.col(v).cast("double")).alias(v) for v in required])
    return filled.unpivot(cell, list(required), "variable", "value")
