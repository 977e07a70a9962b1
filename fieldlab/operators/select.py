"""Row selection: variables, levels, leads, time ranges, subsamples and splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions.keyed import digest
from fieldlab.operators.ranking import random_position, time_axis

NO_START = datetime(1, 1, 1)
NO_END = datetime(9999, 12, 31)


@dataclass(frozen=True)
class TimeRange:
    """A closed interval; None is open. A date as the end covers that whole day."""

    start: date | datetime | None
    end: date | datetime | None

    def holds(self, time: Column) -> Column:
        inside = F.lit(True)
        if self.start is not None:
            inside = inside & (time >= _ntz(self.start))
        if self.end is not None:
            if isinstance(self.end, datetime):
                inside = inside & (time <= _ntz(self.end))
            else:
                inside = inside & (time < _ntz(self.end + timedelta(days=1)))
        return inside

    def overlaps(self, other: TimeRange) -> bool:
        return _floor(self) <= _ceil(other) and _floor(other) <= _ceil(self)


def as_ranges(value) -> list[TimeRange]:
    """Accept nothing, one `[start, end]` pair or a list of pairs; ISO strings, dates and None are ends."""
    if not value:
        return []
    items = list(value)
    if len(items) == 2 and all(item is None or isinstance(item, (str, date)) for item in items):
        items = [items]
    return [TimeRange(_when(a), _when(b)) for a, b in items]


def check_no_overlap(train, test, what: str = "train/test") -> None:
    """Raise when a train range and a test range share a moment (ends compared as midnights)."""
    for a in as_ranges(train):
        for b in as_ranges(test):
            if a.overlaps(b):
                raise ValueError(f"{what} ranges overlap: {a} and {b}")


def select_time_ranges(df: DataFrame, ranges, time: str = "init_time") -> DataFrame:
    """Rows inside each range; a row inside two ranges appears twice. No ranges means all rows.

    The union of the ranges is also a plain predicate, so it reaches the scan.
    """
    spans = as_ranges(ranges)
    if not spans:
        return df
    inside = [r.holds(F.col(time)) for r in spans]
    any_range = inside[0]
    for cond in inside[1:]:
        any_range = any_range | cond
    if not any(a.overlaps(b) for i, a in enumerate(spans) for b in spans[:i]):
        return df.where(any_range)
    hits = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]), lambda i: i.isNotNull())
    return df.where(any_range).withColumn("_range", F.explode(hits)).drop("_range")


def in_ranges(ranges, time: Column) -> Column:
    """True where the time lies in any of the ranges (or there are none)."""
    found = F.lit(not as_ranges(ranges))
    for r in as_ranges(ranges):
        found = found | r.holds(time)
    return found


def select_time_ranges_strict(df: DataFrame, ranges, time: str = "init_time") -> DataFrame:
    """As `select_time_ranges`, sorted by time; raises when nothing is left."""
    out = select_time_ranges(df, ranges, time)
    if out.isEmpty():
        raise ValueError(f"no rows in time ranges {ranges}")
    return out.orderBy(time)


def select_variables(df: DataFrame, variables: Sequence[str] | None, fallback: str | None = None) -> DataFrame:
    names = list(variables) if variables else [fallback]
    return df.where(F.col("variable").isin(names))


def missing_variables(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(source, variable) pairs of the required variables that a source lacks."""
    have = df.groupBy("source").agg(F.collect_set(F.when(F.col("variable").isin(list(required)), F.col("variable"))).alias("have"))
    wanted = F.array(*[F.lit(v) for v in required])
    return have.select("source", F.explode(F.array_except(wanted, "have")).alias("variable"))


def available_variables(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.where(F.col("variable").isin(list(required))).select("source", "variable").distinct()


def require_variables(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Return `df`; raise when a source lacks a required variable."""
    gaps = missing_variables(df, required)
    first = gaps.orderBy("source", "variable").limit(20).collect()
    if first:
        raise ValueError(f"{gaps.count()} missing variables, first: " + ", ".join(f"{r.source}/{r.variable}" for r in first))
    return df


def select_level(df: DataFrame, level: int | None) -> DataFrame:
    """One pressure level; data without levels passes through."""
    return df if level is None else df.where((F.col("level") == level) | F.col("level").isNull())


def filter_leads(df: DataFrame, leads: Sequence[int] | None) -> DataFrame:
    """The listed leads; None keeps all positive ones. Rows without a lead stay."""
    lead = F.col("lead_hours")
    wanted = lead > 0 if leads is None else lead.isin(list(leads))
    return df.where(wanted | lead.isNull())


def missing_leads(df: DataFrame, leads: Sequence[int]) -> DataFrame:
    """(source, lead_hours) pairs that were asked for and are absent."""
    have = df.groupBy("source").agg(F.collect_set("lead_hours").alias("have"))
    wanted = F.array(*[F.lit(h).cast("int") for h in leads])
    return have.select("source", F.explode(F.array_except(wanted, "have")).alias("lead_hours"))


def zero_lead(df: DataFrame) -> DataFrame:
    """For each source, lead 0 if it has one, else its first lead."""
    first = df.groupBy("source").agg(F.min("lead_hours").alias("_first"), F.max((F.col("lead_hours") == 0)).alias("_zero"))
    chosen = first.select("source", F.when(F.col("_zero"), 0).otherwise(F.col("_first")).alias("lead_hours"))
    return df.join(F.broadcast(chosen), ["source", "lead_hours"], "left_semi")  # one row per source


def range_fallback(df: DataFrame, ranges, fallback=None, time: str = "init_time") -> DataFrame:
    """Rows in `ranges`; a source without any falls back to `fallback` ranges (all rows when None)."""
    inside = in_ranges(ranges, F.col(time))
    served = df.groupBy("source").agg(F.max(inside).alias("_served"))
    other = in_ranges(fallback, F.col(time))
    return df.join(F.broadcast(served), "source").where(inside | (~F.col("_served") & other)).drop("_served")


def even_subsample(df: DataFrame, k: int, within: Sequence[str] = ("source",), time: str = "init_time") -> DataFrame:
    """At most `k` evenly spaced times per group, first and last included; no-op for k = 0 or few times."""
    if k <= 0:
        return df
    axis = time_axis(df, within, time)
    sizes = axis.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
    step = (F.col("_n") - 1) / F.lit(max(k - 1, 1)).cast("double")
    index = (
        F.when(F.col("_n") <= k, F.col("_i"))
        .when(F.col("_i") == k - 1, F.when(F.lit(k == 1), 0).otherwise(F.col("_n") - 1))
        .otherwise(F.floor(F.col("_i") * step))
    )
    picks = (
        sizes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n").cast("int")) - 1)))
        .select(*within, index.cast("bigint").alias("t_idx"))
    )
    chosen = axis.join(F.broadcast(picks), [*within, "t_idx"], "left_semi").drop("t_idx")  # at most k rows per group
    return df.join(F.broadcast(chosen), [*within, time], "left_semi")


def time_split(df: DataFrame, ratio: float, within: Sequence[str] = ("source",), delta: int = 0, time: str = "init_time"):
    """Label rows 'train' or 'val' by time order, cut at int(n * ratio).

    With `delta`, the first `delta` times of each split are dropped so that every prior lies in the same split.
    """
    axis = time_axis(df, within, time)
    sizes = axis.groupBy(*within).agg(F.floor(F.count(F.lit(1)) * ratio).alias("_cut"))
    labelled = axis.join(F.broadcast(sizes), list(within)).select(
        *within,
        time,
        F.when(F.col("t_idx") < F.col("_cut"), "train").otherwise("val").alias("split"),
        F.when(F.col("t_idx") < F.col("_cut"), F.col("t_idx")).otherwise(F.col("t_idx") - F.col("_cut")).alias("split_idx"),
    )
    return df.join(labelled.where(F.col("split_idx") >= delta), [*within, time])


def reference_pool(reference: DataFrame, forecast: DataFrame, restrict_dates: bool = True, time: str = "init_time"):
    """Reference rows at the hours of day of the forecast, inside its date span when restricted."""
    ends = F.struct(F.min(time).alias("lo"), F.max(time).alias("hi"), F.collect_set(F.hour(time)).alias("hours"))
    span = forecast.agg(ends.alias("span")).scalar()
    keep = F.array_contains(span["hours"], F.hour(time))
    if restrict_dates:
        keep = keep & F.col(time).between(span["lo"], span["hi"])
    return reference.where(keep)


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cap_random(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A keyed random sample of at most n rows, without replacement (a top-n by hash)."""
    return df.withColumn("_h", digest(seed, "cap", F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def split_halves(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Two disjoint random halves 'a' and 'b' of size n // 2; an odd row is left out."""
    ranked = random_position(df, [seed, "half", F.col(key)], name="_p")
    half = F.floor(df.agg(F.count(F.lit(1))).scalar() / 2)
    return (
        ranked.withColumn("half", F.when(F.col("_p") < half, "a").when(F.col("_p") < half * 2, "b"))
        .where(F.col("half").isNotNull())
        .drop("_p")
    )


def random_split(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """Random train/test split: max(1, int(n * ratio)) train rows; with no rows left, test equals train."""
    ranked = random_position(df, [seed, "split", F.col(key)], name="_p")
    n = df.agg(F.count(F.lit(1))).scalar()
    cut = F.greatest(F.lit(1), F.floor(n * ratio))
    parts = F.when(n <= cut, F.array(F.lit("train"), F.lit("test"))).otherwise(
        F.array(F.when(F.col("_p") < cut, "train").otherwise("test"))
    )
    return ranked.withColumn("split", F.explode(parts)).drop("_p")


def ranges_table(spark: SparkSession, train, test) -> DataFrame:
    """Configured ranges as a table, for reports."""
    rows = [("train", _date_or_none(r.start), _date_or_none(r.end)) for r in as_ranges(train)]
    rows += [("test", _date_or_none(r.start), _date_or_none(r.end)) for r in as_ranges(test)]
    return spark.createDataFrame(rows, "split string, start date, end date")


def _when(value):
    if not isinstance(value, str):
        return value
    return date.fromisoformat(value) if len(value) == 10 else datetime.fromisoformat(value)


def _midnight(value: date | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)


def _floor(r: TimeRange) -> datetime:
    return NO_START if r.start is None else _midnight(r.start)


def _ceil(r: TimeRange) -> datetime:
    return NO_END if r.end is None else _midnight(r.end)


def _ntz(value: date | datetime) -> Column:
    return F.lit(_midnight(value).isoformat(sep=" ")).cast("timestamp_ntz")


def _date_or_none(value) -> date | None:
    return value.date() if isinstance(value, datetime) else value
