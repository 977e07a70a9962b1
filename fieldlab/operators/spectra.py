"""Power spectra of snapshots. The FFT of a field is an Arrow step on one row; every average is a Spark aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldlab.functions.arrays import DOUBLES
from fieldlab.functions.reuse import stored


def powers(fields: np.ndarray) -> np.ndarray:
    """|FFT|^2 of fields (n, h, w), each minus its mean, unshifted. The mean term, zero by construction, is set to 0."""
    power = np.abs(np.fft.fft2(fields - fields.mean(axis=(1, 2), keepdims=True))) ** 2
    power[:, 0, 0] = 0.0
    return power


@pandas_udf(DOUBLES)
def fft_power(values: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """`powers` of row-major fields."""
    return pd.Series([powers(np.asarray(v, dtype=float).reshape(1, int(hh), int(ww))).ravel() for v, hh, ww in zip(values, h, w)])


def _same_size(rows: pd.DataFrame, by: Sequence[str], at_once: int = 1 << 20) -> Iterator[tuple[tuple, pd.DataFrame, np.ndarray]]:
    """(key, rows, fields) of a batch, by key and size, some million cells at a time."""
    for key, part in rows.groupby([*by, "h", "w"], dropna=False):
        h, w = (int(x) for x in key[-2:])
        step = max(1, at_once // max(1, h * w))
        for start in range(0, len(part), step):
            some = part.iloc[start : start + step]
            yield key, some, np.stack(some["values"].to_numpy()).astype(float).reshape(-1, h, w)


def _summed(rows: DataFrame, keys: Sequence[str], add: Callable) -> DataFrame:
    """(keys, n, total): the rows of each task that have equal keys in one row, `total` being the sum of arrays; `add(batch)` yields
    (key, n, array).
    """
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for batch in batches:
            for key, n, total in add(batch):
                old = state.get(key)
                state[key] = (n, total) if old is None else (old[0] + n, old[1] + total)
        if state:
            out = pd.DataFrame(list(state), columns=list(keys))
            yield out.assign(n=[n for n, _ in state.values()], total=[t for _, t in state.values()])

    return rows.mapInPandas(work, f"{types}, n long, total array<double>")


def psd_2d(snapshots: DataFrame, by: Sequence[str] = ("source", "variable")) -> DataFrame:
    """Mean of log10(power + 1e-8) per wavenumber, shifted so that k = 0 sits at (h div 2, w div 2).

    A task adds up its fields as arrays; only these sums, one per task and key, are taken apart.
    """

    def add(batch: pd.DataFrame):
        for key, some, fields in _same_size(batch, by):
            logs = np.log10(powers(fields) + 1e-8).sum(axis=0)
            yield key, len(some), np.roll(logs, (logs.shape[0] // 2, logs.shape[1] // 2), (0, 1)).ravel()

    sums = _summed(snapshots.select(*by, "h", "w", "values"), [*by, "h", "w"], add)
    cells = sums.select(*by, "h", "w", "n", F.posexplode("total").alias("_p", "_s"))
    ky, kx = F.floor(F.col("_p") / F.col("w")).cast("int"), (F.col("_p") % F.col("w")).cast("int")
    return cells.groupBy(*by, ky.alias("ky"), kx.alias("kx")).agg((F.sum("_s") / F.sum("n")).alias("log_power"))


@pandas_udf(DOUBLES)
def ring_means(power: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """log10 of the mean power on rings 0 .. min(h div 2, w div 2) - 1 around k = 0; an empty ring is null."""
    out = []
    for p, hh, ww in zip(power, h, w):
        hh, ww = int(hh), int(ww)
        dy = np.abs(np.fft.fftfreq(hh) * hh)
        dx = np.abs(np.fft.fftfreq(ww) * ww)
        ring = np.rint(np.hypot(dy[:, None], dx[None, :])).astype(int).ravel()
        count = np.bincount(ring)
        total = np.bincount(ring, weights=np.asarray(p, dtype=float))
        m = min(hh // 2, ww // 2)
        out.append([np.log10(t / c + 1e-10) if c else None for t, c in zip(total[:m], count[:m])])
    return pd.Series(out)


def psd_radial(snapshots: DataFrame, by: Sequence[str] = ("source", "variable")) -> DataFrame:
    """Radial spectrum: per snapshot the log of each ring's mean power, then the mean of the logs over snapshots."""
    rings = snapshots.select(*by, F.posexplode(ring_means(fft_power("values", "h", "w"), "h", "w")).alias("k", "_v"))
    return rings.groupBy(*by, "k").agg(F.avg("_v").alias("log_power"), F.count("_v").alias("n"))


def psd_histogram(snapshots: DataFrame, by: str = "source", over: Sequence[str] = ("variable",), edges: int = 100) -> DataFrame:
    """Density of FFT magnitudes on log-spaced bins that span all sources of a variable jointly; zeros are left out.

    `edges` edges make edges - 1 bins; the top edge belongs to the last bin; density is count / (n * bin width). Magnitudes stay in arrays,
    beside their least and largest; a task counts its fields into one histogram per key.
    """
    bins, keys = edges - 1, [by, *over]
    power = fft_power("values", "h", "w")
    fields = snapshots.select(*keys, F.transform(F.filter(power, lambda p: p > 0), lambda p: F.log10(p) / 2).alias("m"))
    fields = stored(fields.withColumns({"lo": F.array_min("m"), "hi": F.array_max("m")}))  # each field's FFT is taken once, for both passes
    ends = stored(fields.groupBy(*over).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))

    def add(batch: pd.DataFrame):
        for key, part in batch.groupby([*keys, "lo", "hi"], dropna=False):
            m, (lo, hi) = np.concatenate(part["m"].to_numpy()), key[-2:]
            index = np.minimum((m - lo) / ((hi - lo) / bins), bins - 1).astype(int) if hi > lo else np.zeros(len(m), int)
            yield key, len(m), np.bincount(index, minlength=bins).astype(float)

    width = (F.col("hi") - F.col("lo")) / bins
    sums = _summed(fields.drop("lo", "hi").join(ends, list(over)).where("lo is not null"), [*keys, "lo", "hi"], add)
    cells = sums.select(*keys, "lo", "hi", F.posexplode("total").alias("bin", "_n")).where("_n > 0")
    counts = cells.groupBy(*keys, "lo", "hi", "bin").agg(F.sum("_n").cast("long").alias("n"))
    totals = counts.groupBy(by, *over).agg(F.sum("n").alias("_total"))
    left = F.pow(F.lit(10.0), F.col("lo") + F.col("bin") * width)
    right = F.pow(F.lit(10.0), F.col("lo") + (F.col("bin") + 1) * width)
    return counts.join(totals, [by, *over]).select(
        by, *over, "bin", "n", left.alias("left"), right.alias("right"), F.try_divide(F.col("n"), F.col("_total") * (right - left)).alias("density")
    )
