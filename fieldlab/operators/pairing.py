"""Pairing snapshots in time: by index, by exact time, by nearest time, across sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlab.functions.reuse import stored
from fieldlab.functions.times import epoch_micros, epoch_seconds, shift_hours, valid_time
from fieldlab.operators.ranking import time_axis

AXIS = ("source", "lead_hours")


def prior_by_index(
    df: DataFrame, delta_steps: int, keys: Sequence[str] = ("variable", "y", "x"), within: Sequence[str] = AXIS, value: str = "value"
) -> DataFrame:
    """Add `prior_time` and `prior_<value>`: the row of the same keys `delta_steps` places earlier on the time axis; rows without one go.

    Only the small time axis is ranked. The data are exchanged once, by key, and a range frame at -delta of the time index reads the
    prior. A frame holds the times of one cell, or of one snapshot's fields where the values are arrays. Keys are unique per time.
    """
    axis = stored(time_axis(df, within))  # far smaller than the data; written, so that its size decides how it is joined
    earlier = W.partitionBy(*within, *keys).orderBy("t_idx").rangeBetween(-delta_steps, -delta_steps)
    prior = F.first(F.struct(F.col("init_time").alias("t"), F.col(value).alias("v"))).over(earlier)
    paired = df.join(axis, [*within, "init_time"]).withColumn("_p", prior).where(F.col("_p").isNotNull())
    return paired.select(*df.columns, F.col("_p.t").alias("prior_time"), F.col("_p.v").alias(f"prior_{value}"))


def diff_fields(pairs: DataFrame) -> DataFrame:
    """Snapshot pairs with `values` replaced by values - prior_values, cell by cell; null where either is missing."""
    return pairs.withColumn("values", F.zip_with("values", "prior_values", lambda a, b: a - b)).drop("prior_values")


def prior_exact(present: DataFrame, prior: DataFrame, delta_hours: int, on: Sequence[str], time: str, value: str):
    """Pairs whose prior is exactly `delta_hours` earlier; unmatched rows are dropped."""
    looked_up = prior.select(
        *on, shift_hours(F.col(time), delta_hours).alias(time), F.col(time).alias("prior_time"), F.col(value).alias(f"prior_{value}")
    )
    return present.join(looked_up, [*on, time])


def prior_dropped(present: DataFrame, prior: DataFrame, delta_hours: int, on: Sequence[str], time: str) -> DataFrame:
    """Rows that have no exact prior."""
    looked_up = prior.select(*on, shift_hours(F.col(time), delta_hours).alias(time))
    return present.join(looked_up, [*on, time], "left_anti")


def pair_valid_time(forecast: DataFrame, reference: DataFrame, keys: Sequence[str] = ("variable", "y", "x")) -> DataFrame:
    """Forecast cells next to the reference cells at their valid time."""
    ref = reference.select(*keys, F.col("init_time").alias("valid_time"), F.col("value").alias("ref_value"))
    return forecast.withColumn("valid_time", valid_time(F.col("init_time"), F.col("lead_hours"))).join(ref, [*keys, "valid_time"])


def pair_cross_source(
    forecast: DataFrame, reference: DataFrame, delta_hours: int, keys: Sequence[str] = ("variable", "y", "x")
) -> DataFrame:
    """Present from the forecast, prior always from the reference, `delta_hours` before the valid time."""
    ref = reference.select(*keys, F.col("init_time").alias("prior_time"), F.col("value").alias("prior_value"))
    when = shift_hours(valid_time(F.col("init_time"), F.col("lead_hours")), -delta_hours)
    return forecast.withColumn("prior_time", when).join(ref, [*keys, "prior_time"])


def nearest_time(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    right_id: str,
    tolerance_hours: float | None = None,
) -> DataFrame:
    """Match each left row to the right row nearest in time; the earlier one wins a tie, then the smaller id.

    Adds `match_time`, `match_id` and `match_gap_s`. Rows further than the tolerance are dropped.

    Only distinct times take part. The nearest earlier and later right times are carried in three steps: over the days of a key, over
    the seconds of a day, over the moments of a second. Each window is bounded by the calendar, so a crowded day or key stays
    spread over tasks, and no pair of rows inside a time bucket is ever formed.
    """
    times = (
        left.select(*on, F.col(left_time).alias("_t"), F.lit(None).cast("bigint").alias("_id"))
        .unionByName(right.select(*on, F.col(right_time).alias("_t"), F.col(right_id).cast("bigint").alias("_id")))
        .where(F.col("_t").isNotNull())
        .groupBy(*on, "_t")
        .agg(F.min("_id").alias("_id"))
        .withColumn("_day", F.col("_t").cast("date"))
        .withColumn("_sec", epoch_seconds(F.col("_t")))
    )
    hit = F.when(F.col("_id").isNotNull(), F.struct("_t", "_id"))
    ends = [F.max(hit).alias("_last"), F.min(hit).alias("_first")]

    every = list(on) or [F.lit(0)]
    days = times.groupBy(*on, "_day").agg(*ends)
    days = days.select(
        *on, "_day", _before("_last", every, "_day").alias("_dp"), _after("_first", every, "_day").alias("_dn")
    )

    seconds = times.groupBy(*on, "_day", "_sec").agg(*ends).join(days, [*on, "_day"])
    day = [*on, "_day"]
    seconds = seconds.select(
        *day,
        "_sec",
        F.coalesce(_before("_last", day, "_sec"), "_dp").alias("_sp"),
        F.coalesce(_after("_first", day, "_sec"), "_dn").alias("_sn"),
    )

    second = [*on, "_day", "_sec"]
    moments = times.withColumn("_hit", hit).join(seconds, second)
    matched = moments.select(
        *on,
        "_t",
        F.coalesce("_hit", _before("_hit", second, "_t"), "_sp").alias("_prev"),
        F.coalesce("_hit", _after("_hit", second, "_t"), "_sn").alias("_next"),
    )
    now = epoch_micros(F.col("_t"))
    gap_prev, gap_next = now - epoch_micros(F.col("_prev._t")), epoch_micros(F.col("_next._t")) - now
    take_prev = F.col("_next").isNull() | (F.col("_prev").isNotNull() & (gap_prev <= gap_next))
    best = matched.select(
        *on,
        F.col("_t").alias(left_time),
        F.when(take_prev, F.col("_prev._t")).otherwise(F.col("_next._t")).alias("match_time"),
        F.when(take_prev, F.col("_prev._id")).otherwise(F.col("_next._id")).alias("match_id"),
        (F.when(take_prev, gap_prev).otherwise(gap_next) / 1e6).alias("match_gap_s"),
    ).where(F.col("match_id").isNotNull())
    if tolerance_hours is not None:
        best = best.where(F.col("match_gap_s") <= tolerance_hours * 3600)
    return left.join(best, [*on, left_time])


def _before(column: str, within: Sequence, order: str) -> Column:
    """Last value before this row."""
    return F.last(column, ignorenulls=True).over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1))


def _after(column: str, within: Sequence, order: str) -> Column:
    """First value after this row, as the last one before it in the opposite order: a frame that grows costs one step per row,
    one that shrinks is summed anew for each."""
    opposite = W.partitionBy(*within).orderBy(F.col(order).desc())
    return F.last(column, ignorenulls=True).over(opposite.rowsBetween(W.unboundedPreceding, -1))


def spacing(df: DataFrame, within: Sequence[str], time: str = "init_time") -> DataFrame:
    """Time spacing per group: n, first, last, step_s and whether the times are evenly spaced.

    n distinct times spread over (last - first) are even exactly when each is a whole number of mean steps from the first, so
    two aggregates decide it and nothing is sorted.
    """
    times = df.select(*within, epoch_seconds(F.col(time)).alias("_t")).distinct()
    ends = times.groupBy(*within).agg(F.min("_t").alias("first_s"), F.max("_t").alias("last_s"), F.count("_t").alias("n"))
    step = F.when(F.col("n") > 1, (F.col("last_s") - F.col("first_s")) / (F.col("n") - 1))
    ends = ends.withColumn("step_s", step)
    off = (F.col("_t") - F.col("first_s")) % F.col("step_s") != 0
    return (
        times.join(F.broadcast(ends), list(within))  # one row per group
        .groupBy(*within, "n", "first_s", "last_s", "step_s")
        .agg(F.max(F.coalesce(off, F.lit(False))).alias("_off"))
        .withColumn("uniform", ~F.col("_off"))
        .drop("_off")
    )


def delta_steps(df: DataFrame, delta_hours: float, within: Sequence[str], time: str = "init_time", strict: bool = True) -> DataFrame:
    """Index offset of `delta_hours` per group. Uneven spacing, a single time, or a remainder is an error when strict, else null."""
    grid = spacing(df, within, time)
    steps = delta_hours * 3600 / F.col("step_s")
    whole = F.abs(steps - F.rint(steps)) <= 1e-6
    ok = (F.col("n") > 1) & F.col("uniform") & whole
    value = F.rint(steps).cast("bigint")
    bad = F.raise_error(F.lit(f"{delta_hours} h is not a whole number of even time steps")).cast("bigint")
    return grid.withColumn("delta_steps", F.when(ok, value).otherwise(bad if strict else F.lit(None)))
