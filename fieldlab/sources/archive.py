"""Archives of cells in Parquet: schema, scans, extracts and profiles.

cell: one row per (source, init_time, lead_hours, level, variable, y, x). Written by source and year, so that a scan prunes both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab.functions.times import valid_time
from fieldlab.operators.ranking import time_axis
from fieldlab.operators.select import in_ranges, missing_leads

_SAMPLE = [
    T.StructField("source", T.StringType()),
    T.StructField("init_time", T.TimestampNTZType()),
    T.StructField("lead_hours", T.IntegerType()),
]
CELL_SCHEMA = T.StructType(
    [
        *_SAMPLE,
        T.StructField("level", T.IntegerType()),
        T.StructField("variable", T.StringType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("value", T.FloatType()),
    ]
)


def write_cells(cells: DataFrame, path: str, mode: str = "error") -> None:
    """Write by source and year of the initial time, with the rows of a partition gathered and sorted for row-group pruning.

    The shuffle key also holds month and variable, so a large source is spread over many tasks.
    """
    out = cells.withColumn("year", F.year("init_time"))
    keyed = out.repartition("source", "year", F.month("init_time"), "variable")
    keyed.sortWithinPartitions("variable", "init_time").write.mode(mode).partitionBy("source", "year").parquet(path)


def read_cells(
    spark: SparkSession, path: str, sources: Sequence[str] | None = None, variables: Sequence[str] | None = None, ranges=None
) -> DataFrame:
    """Scan of an archive; source and year prune directories, variable and time reach the Parquet filter."""
    df = spark.read.schema(T.StructType([*CELL_SCHEMA, T.StructField("year", T.IntegerType())])).parquet(path)
    if sources:
        df = df.where(F.col("source").isin(list(sources)))
    return time_slice(df, variables, ranges).drop("year")


def time_slice(df: DataFrame, variables: Sequence[str] | None = None, ranges=None) -> DataFrame:
    """Chosen variables inside the time ranges; with a `year` column the ranges also prune years."""
    from fieldlab.operators.select import as_ranges

    if variables:
        df = df.where(F.col("variable").isin(list(variables)))
    spans = as_ranges(ranges)
    if spans and "year" in df.columns:
        years = [
            (F.col("year") >= r.start.year if r.start else F.lit(True)) & (F.col("year") <= r.end.year if r.end else F.lit(True))
            for r in spans
        ]
        cond = years[0]
        for y in years[1:]:
            cond = cond | y
        df = df.where(cond)
    return df.where(in_ranges(ranges, F.col("init_time"))) if spans else df


def index_slice(df: DataFrame, start: int, stop: int, within: Sequence[str] = ("source",)) -> DataFrame:
    """Rows whose time index lies in [start, stop)."""
    axis = time_axis(df, within).where((F.col("t_idx") >= start) & (F.col("t_idx") < stop))
    return df.join(axis.drop("t_idx"), [*within, "init_time"], "left_semi")


def at_indices(df: DataFrame, indices: DataFrame, within: Sequence[str] = ("source",)) -> DataFrame:
    """Rows at a table (within, t_idx) of time indices."""
    axis = time_axis(df, within).join(indices, [*within, "t_idx"], "left_semi").drop("t_idx")
    return df.join(axis, [*within, "init_time"], "left_semi")


def forecast_at_lead(df: DataFrame, lead: int) -> DataFrame:
    """One lead, re-stamped to valid time. The data must have leads."""
    if "lead_hours" not in df.columns:
        raise ValueError("data has no lead_hours column")
    return df.where(F.col("lead_hours") == lead).withColumn("valid_time", valid_time(F.col("init_time"), F.col("lead_hours")))


def extract_archive(df: DataFrame, variables: Sequence[str], ranges, leads: Sequence[int] | None = None):
    """(extract, missing leads): chosen variables, times and leads. An empty extract raises."""
    chosen = time_slice(df, variables, ranges)
    missing = None
    if leads is not None:
        missing = missing_leads(chosen, leads)
        chosen = chosen.where(F.col("lead_hours").isin(list(leads)))
    if chosen.isEmpty():
        raise ValueError(f"nothing left for variables {list(variables)}, ranges {ranges}, leads {leads}")
    return chosen, missing


def extract_forecast(df: DataFrame, variables: Sequence[str], ranges, lead: int) -> DataFrame:
    """Available variables at one lead, stamped with valid time before the time slice. An absent lead or an empty extract raises."""
    at = forecast_at_lead(df.where(F.col("variable").isin(list(variables))), lead)
    if at.isEmpty():
        raise ValueError(f"lead {lead} h is absent")
    out = at.where(in_ranges(ranges, F.col("valid_time")))
    if out.isEmpty():
        raise ValueError(f"no rows in {ranges}")
    return out


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All frames under one schema, tagged with their names."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def profile_variables(df: DataFrame) -> DataFrame:
    """Per variable: rows, value range, and the extent of time, latitude and longitude."""
    return df.groupBy("variable").agg(
        F.count("value").alias("n"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min("init_time").alias("first_time"),
        F.max("init_time").alias("last_time"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
    )


def profile_leads(df: DataFrame) -> DataFrame:
    """Per source: the lead hours present, as distinct rows."""
    return df.select("source", "lead_hours").distinct()


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """Paths under a directory, without reading the files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    return found.select("path")
