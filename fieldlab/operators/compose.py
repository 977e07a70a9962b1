"""Channel composition and grid geometry."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldlab.functions.arrays import DOUBLES, indices, let
from fieldlab.operators.stats import safe_std

# Clip bound of normalized differences; padding rows/columns; the padded size of the model's fields; temporal modes.
DIFF_CLIP = 15.0
PAD_TOP, PAD_BOTTOM, PAD_LEFT, PAD_RIGHT = 4, 3, 8, 8
PADDED_SHAPE = (128, 256)
MODES = ("none", "diff", "concat", "phase")


def clip_diff(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(DIFF_CLIP)), F.lit(-DIFF_CLIP))


def compose(pairs: DataFrame, mode: str, variables: Sequence[str], abs_stats: DataFrame, diff_stats: DataFrame | None = None):
    """Model input channels from rows with `value` and, but for 'none', `prior_value`.

    none: z(present). diff: clipped z(present - prior) by the difference statistics. concat: z(prior), then z(present).
    phase: z(present), then clipped differences. Adds `channel`, numbered in the order of `variables`.
    """
    if mode not in MODES:
        raise ValueError(f"unknown temporal mode {mode!r}; one of {MODES}")
    if mode in ("diff", "phase") and diff_stats is None:
        raise ValueError(f"mode {mode!r} needs difference statistics")
    if mode != "none" and "prior_value" not in pairs.columns:
        raise ValueError(f"mode {mode!r} needs prior values")
    a = abs_stats.select("variable", F.col("mean").alias("_am"), safe_std(F.col("std")).alias("_as"))
    df = pairs.join(F.broadcast(a), "variable")  # one row per variable
    z_now = (F.col("value") - F.col("_am")) / F.col("_as")
    blocks = [z_now]
    if mode == "concat":
        blocks = [(F.col("prior_value") - F.col("_am")) / F.col("_as"), z_now]
    elif mode != "none":
        d = diff_stats.select("variable", F.col("mean").alias("_dm"), safe_std(F.col("std")).alias("_ds"))
        df = df.join(F.broadcast(d), "variable")
        z_diff = clip_diff((F.col("value") - F.col("prior_value") - F.col("_dm")) / F.col("_ds"))
        blocks = [z_diff] if mode == "diff" else [z_now, z_diff]
    index = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable")) - 1
    parts = F.array(*[F.struct((index + i * len(variables)).alias("channel"), b.alias("value")) for i, b in enumerate(blocks)])
    keep = [c for c in pairs.columns if c not in ("value", "prior_value")]
    return (
        df.where(F.col("variable").isin(list(variables)))
        .select(*keep, F.explode(parts).alias("_c"))
        .select(*keep, F.col("_c.channel").alias("channel"), F.col("_c.value").alias("value"))
    )


def pad_cells(cells: DataFrame, w: int, top: int = PAD_TOP, left: int = PAD_LEFT, right: int = PAD_RIGHT):
    """Shift rows down by `top` and repeat wrapped columns left and right.

    A cell goes to at most a few places, so padding is an explode per cell with no join. Zero rows are implicit in cell form;
    `pad_field` writes them out in array form.
    """
    first = F.pmod(F.col("x") + left, F.lit(w)) - left
    places = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit((left + right) // w + 1)), lambda k: first + k * w),
        lambda x: (x >= -left) & (x < w + right),
    )
    return cells.withColumn("x", F.explode(places)).withColumn("x", F.col("x") + left).withColumn("y", F.col("y") + top)


def pad_field(values: Column, h: Column, w: Column, top=PAD_TOP, bottom=PAD_BOTTOM, left=PAD_LEFT, right=PAD_RIGHT) -> Column:
    """Row-major field padded with zero rows and wrapped columns; the size becomes (h+top+bottom) x (w+left+right)."""
    wide = w + (left + right)

    def padded(a: Column) -> Column:
        def cell(pos: Column) -> Column:
            y = F.floor(pos / wide) - top
            x = F.pmod(pos % wide - left, w)
            return F.when((y >= 0) & (y < h), F.get(a, (y * w + x).cast("int"))).otherwise(0.0)

        return F.transform(indices((h + (top + bottom)) * wide), cell)

    return let(values, padded)


def crop_field(values: Column, h: Column, w: Column, top=PAD_TOP, bottom=PAD_BOTTOM, left=PAD_LEFT, right=PAD_RIGHT) -> Column:
    """Inverse of `pad_field`, given the padded size."""
    inner = w - (left + right)

    def cropped(a: Column) -> Column:
        return F.transform(
            indices((h - (top + bottom)) * inner),
            lambda pos: F.get(a, ((F.floor(pos / inner) + top) * w + pos % inner + left).cast("int")),
        )

    return let(values, cropped)


def crop_if_padded(values: Column, h: Column, w: Column, padded: tuple[int, int]) -> Column:
    """Crop only fields that have the padded size; others pass through."""
    return let(values, lambda a: F.when((h == padded[0]) & (w == padded[1]), crop_field(a, h, w)).otherwise(a))


def transpose_field(values: Column, h: Column, w: Column) -> Column:
    """Row-major (h, w) to row-major (w, h)."""
    return let(
        values, lambda a: F.transform(indices(h * w), lambda p: F.get(a, ((p % h) * w + F.floor(p / h)).cast("int")))
    )


def flip_lon_field(values: Column, w: Column) -> Column:
    return let(
        values, lambda a: F.transform(indices(F.size(a)), lambda p: F.get(a, (p - p % w + (w - 1 - p % w)).cast("int")))
    )


def shift_longitude(lon: Column) -> Column:
    """Degrees in (-180, 180]."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def pivot_channels(cells: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row per sample cell with a column per variable (unpivot is the inverse)."""
    keys = [c for c in cells.columns if c not in ("variable", "value")]
    return cells.groupBy(*keys).pivot("variable", list(variables)).agg(F.first("value"))


def channel_rows(snapshots: DataFrame, variables: Sequence[str], by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(by, h, w, fields): the fields of a sample in channel order. A group has one row per variable."""
    index = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable"))
    return snapshots.where(F.col("variable").isin(list(variables))).groupBy(*by).agg(
        F.first("h").alias("h"),
        F.first("w").alias("w"),
        F.sort_array(F.collect_list(F.struct(index.alias("i"), F.col("values").alias("v")))).alias("fields"),
    )


def flatten_channels(snapshots: DataFrame, variables: Sequence[str], by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(by, vec): all channels of a sample one after the other."""
    rows = channel_rows(snapshots, variables, by)
    return rows.select(*by, F.flatten(F.col("fields.v")).alias("vec"))


def patch_tokens(snapshots: DataFrame, patch: int, variables: Sequence[str], by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(by, tokens): the patches of a sample, row-major; a token has the channels one after the other, each row-major inside it."""
    cols = F.floor(F.col("w") / patch).cast("int")
    inside = F.sequence(F.lit(0), F.lit(patch * patch - 1))

    def tokens(channels: Column) -> Column:
        def one(p: Column) -> Column:
            def cell(f: Column, q: Column) -> Column:
                y = F.floor(p / cols) * patch + F.floor(q / patch)
                return F.get(f["v"], (y * F.col("w") + (p % cols) * patch + q % patch).cast("int"))

            return F.flatten(F.transform(channels, lambda f: F.transform(inside, lambda q: cell(f, q))))

        return F.transform(indices(F.floor(F.col("h") / patch).cast("int") * cols), one)

    return channel_rows(snapshots, variables, by).select(*by, let(F.col("fields"), tokens).alias("tokens"))


def patchify(snapshots: DataFrame, patch: int, variables: Sequence[str], by: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(by, patch, token): `patch_tokens`, one row per patch."""
    return patch_tokens(snapshots, patch, variables, by).select(*by, F.posexplode("tokens").alias("patch", "token"))


def to_snapshots(cells: DataFrame, h: int, w: int) -> DataFrame:
    """Cell rows to one row-major array per (sample, variable). Absent cells are null. A group holds at most h*w cells."""
    @pandas_udf(DOUBLES)
    def dense(pos: pd.Series, value: pd.Series) -> pd.Series:
        out = []
        for p, v in zip(pos, value):
            field = np.full(h * w, np.nan)
            field[np.asarray(p, dtype=int)] = v
            out.append(field)
        return pd.Series(out)

    keys = [c for c in cells.columns if c not in ("y", "x", "lat", "lon", "value")]
    listed = F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("pos"), F.col("value").cast("double").alias("value")))
    grouped = cells.groupBy(*keys).agg(listed.alias("_c"))
    return grouped.select(
        *keys, F.lit(h).alias("h"), F.lit(w).alias("w"), dense(F.col("_c.pos"), F.col("_c.value")).alias("values")
    )


def to_cells(snapshots: DataFrame, value: str = "value") -> DataFrame:
    """Arrays to one row per cell."""
    keys = [c for c in snapshots.columns if c != "values"]
    return snapshots.select(*keys, F.posexplode("values").alias("pos", value)).select(
        *keys, F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).alias("x"), value
    )


def normalize_snapshots(snapshots: DataFrame, stats: DataFrame) -> DataFrame:
    """Z-score on arrays, missing to 0."""
    s = stats.select("variable", F.col("mean").alias("_mean"), safe_std(F.col("std")).alias("_std"))
    z = F.transform("values", lambda v: F.coalesce(F.nanvl((v - F.col("_mean")) / F.col("_std"), F.lit(0.0)), F.lit(0.0)))
    return snapshots.join(F.broadcast(s), "variable").withColumn("values", z).drop("_mean", "_std")


def denormalize_snapshots(snapshots: DataFrame, stats: DataFrame) -> DataFrame:
    s = stats.select("variable", F.col("mean").alias("_mean"), safe_std(F.col("std")).alias("_std"))
    raw = F.transform("values", lambda v: v * F.col("_std") + F.col("_mean"))
    return snapshots.join(F.broadcast(s), "variable").withColumn("values", raw).drop("_mean", "_std")
