"""Time expressions on TIMESTAMP_NTZ columns that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")) * F.lit(86400).cast("bigint") + (
        F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    )


def epoch_micros(ts: Column) -> Column:
    whole_minutes = F.unix_date(ts.cast("date")) * F.lit(1440).cast("bigint") + F.hour(ts) * 60 + F.minute(ts)
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return whole_minutes * 60_000_000 + micros


def shift_hours(ts: Column, hours) -> Column:
    """`ts + hours`; hours may be an integer column or a Python int (negative allowed)."""
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return ts + F.make_dt_interval(F.lit(0), h.cast("int"), F.lit(0), F.lit(0))


def valid_time(init_time: Column, lead_hours: Column) -> Column:
    return shift_hours(init_time, lead_hours)


def lead_to_hours(lead: Column) -> Column:
    """Whole hours of a day-time interval, truncated."""
    seconds = (
        F.date_part(F.lit("DAY"), lead) * 86400
        + F.date_part(F.lit("HOUR"), lead) * 3600
        + F.date_part(F.lit("MINUTE"), lead) * 60
        + F.date_part(F.lit("SECOND"), lead)
    )
    return F.floor(seconds / 3600).cast("int")


def decode_cf(value: Column, units: Column) -> Column:
    """Timestamp of a numeric offset given as 'unit since yyyy-mm-dd'; unknown units count as days."""
    base = F.split(F.split(units, "since ").getItem(1), " ").getItem(0)
    unit = F.lower(F.split(units, " ").getItem(0))
    unit_seconds = (
        F.when(unit.contains("hour"), 3600)
        .when(unit.contains("minute"), 60)
        .when(unit.contains("second"), 1)
        .otherwise(86400)
    )
    micros = F.round(value * unit_seconds * 1_000_000).cast("bigint")
    whole_minutes = F.floor(micros / F.lit(60_000_000))
    hours = F.floor(whole_minutes / 60).cast("int")
    rest = (whole_minutes - hours * F.lit(60).cast("bigint")).cast("int")
    leftover = ((micros - whole_minutes * 60_000_000) / F.lit(1_000_000)).cast("decimal(18,6)")
    start = F.to_date(base).cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), hours, rest, leftover)
