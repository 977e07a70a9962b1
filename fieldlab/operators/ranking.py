"""Positions in a global order without sorting a whole group in one task.

A plain `row_number()` over a source puts every row of that source in one task. Here rows are first counted per bucket,
where the bucket is a monotone function of the order (a day, or a hash prefix). The running total over the buckets, a small table,
gives the offset of each bucket, and only rows of one bucket are numbered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlab.functions.keyed import digest
from fieldlab.functions.reuse import materialize


def position(
    df: DataFrame, order: Sequence[Column | str], bucket: Column, within: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row in `order` inside `within`. `order` must be unique there."""
    keys = [*within, "_bucket"]
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    lower = W.partitionBy(*(within or [F.lit(0)])).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_before"))
    numbered = tagged.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return (
        numbered.join(offsets, keys)
        .withColumn(name, F.col("_before") + F.col("_local") - 1)
        .drop("_bucket", "_before", "_local")
    )


def random_position(df: DataFrame, key: Sequence, within: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Position in a keyed random order; the first four hex digits give 65 536 even buckets."""
    tagged = df.withColumn("_hash", digest(*key))
    order = ["_hash", *[k for k in key if isinstance(k, Column)]]
    return position(tagged, order, F.substring("_hash", 1, 4), within, name).drop("_hash")


def time_axis(df: DataFrame, within: Sequence[str], time: str = "init_time") -> DataFrame:
    """Distinct times with their index `t_idx`, one axis per `within` group.

    The data are read once, for the distinct times; the axis, far smaller, is stored and read as often as needed.
    """
    times = materialize(df.select(*within, time).distinct())
    return position(times, [time], F.col(time).cast("date"), within, "t_idx")

