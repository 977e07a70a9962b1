"""Small result tables: statistics and curves with their provenance."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def save_stats(stats: DataFrame, path: str, mode: str = "none", delta_hours: int | None = None) -> None:
    """Write statistics with the temporal mode and step they were made for."""
    made_for = stats.withColumn("temporal_mode", F.lit(mode)).withColumn("delta_hours", F.lit(delta_hours).cast("int"))
    made_for.write.mode("overwrite").parquet(path)


def load_or_compute_stats(spark: SparkSession, path: str, compute, recompute: bool = False, **tags) -> DataFrame:
    """Stored statistics if there are any, else computed ones, which are stored first."""
    if not recompute:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    save_stats(compute(), path, **tags)
    return spark.read.parquet(path)


def check_compatible(table: DataFrame, mode: str, delta_hours: int | None) -> DataFrame:
    """Return the table; raise when it was made for another mode (a missing one counts as 'none') or time step."""
    has = [F.col(c) if c in table.columns else F.lit(None) for c in ("temporal_mode", "delta_hours")]
    made = table.select(F.coalesce(has[0], F.lit("none")).alias("m"), has[1].cast("int").alias("d"))
    other = F.col("m") != F.lit(mode)
    if mode != "none":
        other = other | ~F.col("d").eqNullSafe(F.lit(delta_hours).cast("int"))
    for r in made.where(other).limit(1).collect():  # one mismatch is enough to refuse
        raise ValueError(f"table was made for mode {r.m!r}, step {r.d}; wanted {mode!r}, {delta_hours}")
    return table


def save_curve(curve: DataFrame, path: str, provenance: dict) -> None:
    """Append rows (metric, series, x, value, stderr, n) with what they were computed from."""
    pairs = [F.lit(t) for k, v in provenance.items() for t in (k, v if isinstance(v, str) else json.dumps(v))]
    curve.withColumn("provenance", F.create_map(*pairs)).write.mode("append").parquet(path)


def lookup_curve(stored: DataFrame, expected: dict, required_series=()) -> DataFrame | None:
    """Stored rows whose provenance matches every expected entry; a missing entry is a mismatch, a missing stderr is 0.

    None when no row is left or a required series is absent, so the caller recomputes.
    """
    fresh = matching_curve(stored, expected)
    have = {r.series for r in fresh.select("series").distinct().collect()}
    return fresh if have and set(required_series) <= have else None


def matching_curve(stored: DataFrame, expected: dict) -> DataFrame:
    match = F.lit(True)
    for k, v in expected.items():
        text = v if isinstance(v, str) else json.dumps(v)
        match = match & F.coalesce(F.element_at("provenance", F.lit(k)) == text, F.lit(False))
    return stored.where(match).withColumn("stderr", F.coalesce("stderr", F.lit(0.0)))
