"""Corruptions of snapshots, in array form: one row per (sample, variable).

Each operator takes a severity (number or column; rows with severity <= 0 are unchanged) and a keyed seed. All but the wind rotation work
row by row without a shuffle: the random choices are functions of the sample key, so the u and v fields of a sample get the
same patch permutation without meeting.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fieldlab.functions.arrays import DOUBLES, indices, let, mean_of, moments_of
from fieldlab.functions.keyed import digest, normal, uniform
from fieldlab.functions.reuse import stored
from fieldlab.operators.compose import PAD_BOTTOM, PAD_LEFT, PAD_RIGHT, PAD_TOP, PADDED_SHAPE

# Scales of the training family at severity 1, ladder end, and the spatial scales.
BLUR_SIGMA = 1.125
NOISE_STD = 0.25
GRF_STD = 0.375
GRF_LENGTH = 10.0
REPLACE_PROB = 0.3
MAX_SEVERITY = 2.0
ANALYSIS_GRF_SIGMA = 2.0
ANALYSIS_PATCH = 8
BLUR_CELLS = 1 << 21  # cells that a task filters at a time

# Accepted names and what they mean.
CORRUPTION_NAMES = {
    "blur": "blur",
    "gaussian_blur": "blur",
    "grf": "grf",
    "gaussian_field_noise": "grf",
    "hf_noise": "noise",
    "high_freq_noise": "noise",
    "pixel_replace": "pixel_replace",
    "random_pixel_replace": "pixel_replace",
    "wind_rotated": "wind_rotation",
    "wind_rotation": "wind_rotation",
    "wind_shuffled": "wind_patch_shuffle",
    "wind_patch_shuffle": "wind_patch_shuffle",
}
LADDER_TYPES = ("blur", "noise", "grf", "pixel_replace", "wind_patch_shuffle", "wind_rotation")
FIELDWISE = ("blur", "grf", "noise", "pixel_replace")

# Analysis disturbances with their levels, and their other names.
DISTURBANCE_LEVELS = {
    "blur": [0, 0.5, 1.5, 3.0, 5.0],
    "noise": [0, 0.1, 0.3, 0.6, 1.0],
    "grf": [0, 0.1, 0.3, 0.6, 1.0],
    "replace": [0, 0.05, 0.15, 0.3, 0.5],
    "patch": [0, 0.05, 0.15, 0.3, 0.5],
    "quant": [256, 64, 32, 16, 8, 4],
}
DISTURBANCE_ALIASES = {
    "gaussian_blur": "blur",
    "hf_noise": "noise",
    "high_freq_noise": "noise",
    "grf_noise": "grf",
    "gaussian_field_noise": "grf",
    "pixel_replace": "replace",
    "random_pixel_replace": "replace",
    "patch_replace": "patch",
    "patch_dropout": "patch",
    "quantization": "quant",
}


def severity_ladder(n_steps: int = 9, max_severity: float = MAX_SEVERITY) -> list[float]:
    if n_steps == 1:
        return [0.0]
    return [max_severity * i / (n_steps - 1) for i in range(n_steps)]


def ladder_sweep(df: DataFrame, types: Sequence[str] = LADDER_TYPES, n_steps: int = 9, max_severity: float = MAX_SEVERITY):
    """Each row at every (corruption, severity), by exploding a literal ladder."""
    unknown = [t for t in types if t not in LADDER_TYPES]
    if unknown:
        raise ValueError(f"unknown corruption {unknown}; one of {LADDER_TYPES}")
    return df.withColumn("corruption", F.explode(F.array(*[F.lit(t) for t in types]))).withColumn(
        "severity", F.explode(F.array(*[F.lit(s) for s in severity_ladder(n_steps, max_severity)]))
    )


def apply_sweep(sweep: DataFrame, types: Sequence[str] = LADDER_TYPES, seed: int = 0, patch: int = 16) -> DataFrame:
    """Corrupt rows (corruption, severity, ...) of a ladder sweep, all severities in one job. The rows of each of `types` take a branch of
    their own, so that no corruption sees rows of another; rows of other types stay as they are.
    """
    named = F.coalesce("corruption", F.lit(""))
    out = sweep.where(~named.isin(list(types)))
    for kind in types:
        options = {"wind_patch_shuffle": {"patch": patch}, "wind_rotation": {"by": ("sample_id", "severity")}}
        out = out.unionByName(CORRUPTIONS[kind](sweep.where(named == kind), F.col("severity"), seed, **options.get(kind, {})))
    return out


def canonical_name(name: str) -> str:
    try:
        return CORRUPTION_NAMES[name]
    except KeyError:
        raise ValueError(f"unknown corruption {name!r}; one of {sorted(CORRUPTION_NAMES)}") from None


# --- spatial filters --------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def blur_taps(sigma: float) -> np.ndarray:
    """The 1-D Gaussian filter: 4-sigma taps that sum to 1."""
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2) if radius else np.ones(1)
    return taps / taps.sum()


def smoothed(fields: np.ndarray, sigma: float) -> np.ndarray:
    """Fields (n, h, w) filtered along both axes with mirrored edges, as a sum of shifted slices: a gap or an infinity reaches as far as
    the taps do and no further.
    """
    taps = blur_taps(sigma)
    radius = len(taps) // 2
    for axis in (1, 2):
        wide = np.pad(fields, [(radius, radius) if k == axis else (0, 0) for k in range(3)], mode="symmetric")
        fields, n = np.zeros_like(fields), fields.shape[axis]
        with np.errstate(invalid="ignore"):  # opposite infinities meet as NaN
            for k, tap in enumerate(taps):
                fields += tap * (wide[:, k : k + n] if axis == 1 else wide[:, :, k : k + n])
    return fields


@pandas_udf(DOUBLES)
def gaussian_blur(values: pd.Series, h: pd.Series, w: pd.Series, sigma: pd.Series) -> pd.Series:
    """Separable Gaussian filter of row-major fields; sigma <= 0 leaves a field as it is. Missing cells are null in the result."""
    out = list(values)
    for (hh, ww, s), rows in pd.DataFrame({"h": h, "w": w, "s": sigma}).reset_index(drop=True).groupby(["h", "w", "s"]).groups.items():
        step = max(1, BLUR_CELLS // max(1, hh * ww))
        for start in range(0, len(rows) if s > 0 else 0, step):
            some = rows[start : start + step]
            batch = np.stack([np.asarray(out[r], dtype=float) for r in some]).reshape(-1, hh, ww)
            for r, field in zip(some, smoothed(batch, float(s))):
                out[r] = field.ravel()
    return pd.Series(out)


gaussian_blur = gaussian_blur.asNondeterministic()  # so that filters which Spark infers above it don't call it a second time


@pandas_udf(DOUBLES)
def spectral_noise(h: pd.Series, w: pd.Series, std: pd.Series, key: pd.Series) -> pd.Series:
    """Gaussian random field of cell variance std^2 and a Gaussian spectrum, from a counter generator keyed by the text."""
    out = []
    for hh, ww, s, k in zip(h, w, std, key):
        hh, ww = int(hh), int(ww)
        f2 = np.fft.fftfreq(hh)[:, None] ** 2 + np.fft.fftfreq(ww)[None, :] ** 2
        power = np.exp(-2.0 * (np.pi * GRF_LENGTH) ** 2 * f2)
        amplitude = np.sqrt(power / power.sum()) * s * hh * ww
        rng = np.random.Generator(np.random.Philox(key=int(hashlib.md5(k.encode()).hexdigest(), 16)))
        white = rng.standard_normal((2, hh, ww))
        out.append(np.fft.ifft2(amplitude * (white[0] + 1j * white[1])).real.ravel())
    return pd.Series(out)


# --- training family: normalized fields --------------------------------------------------------------------------------------


def blur(df: DataFrame, severity, seed: int = 0) -> DataFrame:
    return _changed(df, severity, lambda s: gaussian_blur("values", "h", "w", s * BLUR_SIGMA))


def noise(df: DataFrame, severity, seed: int = 0) -> DataFrame:
    def noisy(s: Column) -> Column:
        return F.transform(
            "values", lambda v, i: v + s * NOISE_STD * normal(seed, "noise", F.col("sample_id"), F.col("variable"), i)
        )

    return _changed(df, severity, noisy)


def grf(df: DataFrame, severity, seed: int = 0) -> DataFrame:
    key = F.concat_ws(":", F.lit(seed), F.lit("grf"), F.col("sample_id"), F.col("variable"))
    return _changed(df, severity, lambda s: F.zip_with("values", spectral_noise("h", "w", s * GRF_STD, key), lambda a, b: a + b))


def pixel_replace(df: DataFrame, severity, seed: int = 0) -> DataFrame:
    def replaced(s: Column) -> Column:
        def cell(v: Column, i: Column) -> Column:
            key = (F.col("sample_id"), F.col("variable"), i)
            return F.when(uniform(seed, "replace", *key) < s * REPLACE_PROB, normal(seed, "fresh", *key)).otherwise(v)

        return F.transform("values", cell)

    return _changed(df, severity, replaced)


def wind_patch_shuffle(df: DataFrame, severity, seed: int = 0, patch: int = 16, wind: Sequence[str] = ("u", "v")) -> DataFrame:
    """Permute rint(severity * n) of the n whole patches of the wind fields. Rows and columns beyond whole patches stay.

    The chosen patches, in one keyed order, receive the same patches in another. u and v follow the same keys.
    """
    s, h, w = _column(severity), F.col("h"), F.col("w")
    cols, rows = F.floor(w / patch).cast("int"), F.floor(h / patch).cast("int")
    n = rows * cols
    k = F.least(F.rint(s * n).cast("int"), n)

    def ordered(patches: Column, purpose: str) -> Column:
        tagged = F.transform(patches, lambda p: F.struct(digest(seed, purpose, F.col("sample_id"), p).alias("d"), p.alias("p")))
        return F.transform(F.sort_array(tagged), lambda t: t["p"])

    def source_of(chosen: Column) -> Column:
        """Source patch of each patch, from a map destination -> source as an array."""
        return let(
            ordered(chosen, "order"),
            lambda given: F.transform(
                indices(n), lambda p: F.coalesce(F.get(given, (F.array_position(chosen, p) - 1).cast("int")), p)
            ),
        )

    def moved(field: Column, source: Column) -> Column:
        def cell(v: Column, i: Column) -> Column:
            y, x = F.floor(i / w), i % w
            whole = (y < rows * patch) & (x < cols * patch)
            src = F.get(source, (F.floor(y / patch) * cols + F.floor(x / patch)).cast("int"))
            from_y = F.floor(src / cols) * patch + y % patch
            from_x = src % cols * patch + x % patch
            return F.when(whole, F.get(field, (from_y * w + from_x).cast("int"))).otherwise(v)

        return F.transform(field, cell)

    picked = F.slice(ordered(indices(n), "pick"), F.lit(1), k)
    shuffled = let(F.col("values"), lambda field: let(let(picked, source_of), lambda source: moved(field, source)))
    active = (s > 0) & (k >= 2) & F.col("variable").isin(list(wind))
    return df.withColumn("values", F.when(active, shuffled).otherwise(F.col("values")))


def wind_rotation(
    df: DataFrame, severity, seed: int = 0, wind: Sequence[str] = ("u", "v"), by: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """Turn every wind vector by severity * 90 degrees. Only the two wind rows of a sample (`by`) are exchanged, to meet in one group;
    other fields, and samples with one component, stay.
    """
    turning = (_column(severity) > 0) & F.col("variable").isin(list(wind))
    rows = df.where(turning).withColumn("_a", _column(severity) * (math.pi / 2))
    samples = rows.groupBy(*by).agg(F.collect_list(F.struct(*rows.columns)).alias("_f"))

    def component(name: str) -> Column:
        return F.get(F.filter("_f", lambda f: f["variable"] == name), F.lit(0))["values"]

    both = samples.select(component(wind[0]).alias("_u"), component(wind[1]).alias("_v"), F.explode("_f").alias("_r"))
    a = F.col("_r._a")
    turned_u = F.zip_with("_u", "_v", lambda p, q: F.cos(a) * p - F.sin(a) * q)
    turned_v = F.zip_with("_u", "_v", lambda p, q: F.sin(a) * p + F.cos(a) * q)
    paired = F.col("_u").isNotNull() & F.col("_v").isNotNull()
    values = F.when(paired, F.when(F.col("_r.variable") == wind[0], turned_u).otherwise(turned_v)).otherwise(F.col("_r.values"))
    turned = both.select(*[values.alias("values") if c == "values" else F.col(f"_r.{c}").alias(c) for c in df.columns])
    return df.where(~F.coalesce(turning, F.lit(False))).unionByName(turned)


CORRUPTIONS: dict[str, Callable[..., DataFrame]] = {
    "blur": blur,
    "noise": noise,
    "grf": grf,
    "pixel_replace": pixel_replace,
    "wind_patch_shuffle": wind_patch_shuffle,
    "wind_rotation": wind_rotation,
}


def _resized(df: DataFrame, before: tuple[int, int], after: tuple[int, int], change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Fields (n, h, w) of one size through `change`, batch by batch. A step of its own in the plan: Spark cannot chain the corruptions'
    Python functions with others across its own array functions.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column("values").flatten().to_numpy(zero_copy_only=False), dtype=float)
            cells = change(flat.reshape(-1, *before)).reshape(-1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (after[0] * after[1]))
            fresh = {"values": pa.ListArray.from_arrays(ends, pa.array(cells, from_pandas=True)), "h": np.full(batch.num_rows, after[0]), "w": np.full(batch.num_rows, after[1])}
            columns = [pa.array(fresh[f.name]).cast(f.type) if f.name in fresh else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(work, df.schema)


def on_interior(df: DataFrame, severity, change: Callable[[DataFrame], DataFrame], padded: tuple[int, int] = PADDED_SHAPE) -> DataFrame:
    """`change` on the interior of fields that have the padded size, and on whole fields of any other size.

    Such a field loses its padding, is changed, and gets the padding anew: zero rows, and columns wrapped from the changed interior. Rows
    with severity <= 0 keep the padding they have. The two kinds of rows take a branch each.
    """
    sized = F.coalesce((F.col("h") == padded[0]) & (F.col("w") == padded[1]) & (_column(severity) > 0), F.lit(False))
    bare = (padded[0] - PAD_TOP - PAD_BOTTOM, padded[1] - PAD_LEFT - PAD_RIGHT)

    def crop(fields: np.ndarray) -> np.ndarray:
        return fields[:, PAD_TOP : padded[0] - PAD_BOTTOM, PAD_LEFT : padded[1] - PAD_RIGHT]

    def pad(fields: np.ndarray) -> np.ndarray:
        wide = np.pad(fields, ((0, 0), (0, 0), (PAD_LEFT, PAD_RIGHT)), mode="wrap")
        return np.pad(wide, ((0, 0), (PAD_TOP, PAD_BOTTOM), (0, 0)))

    outer = _resized(change(_resized(df.where(sized), padded, bare, crop)), bare, padded, pad)
    return change(df.where(~sized)).unionByName(outer)


def corrupt(df: DataFrame, name: str, severity, seed: int = 0, padded: tuple[int, int] = PADDED_SHAPE, **options) -> DataFrame:
    """Apply a corruption by any of its names; to the interior of fields that have the `padded` size."""
    kind = name if name in CORRUPTIONS else canonical_name(name)
    return on_interior(df, severity, lambda rows: CORRUPTIONS[kind](rows, severity, seed, **options), padded)


def corrupt_fieldwise(df: DataFrame, name: str, variable: str, severity, seed: int = 0, padded: tuple[int, int] = PADDED_SHAPE) -> DataFrame:
    """Corrupt one variable and leave the others, padded fields inside; the wind corruptions need both components and are refused."""
    kind = name if name in CORRUPTIONS else canonical_name(name)
    if kind not in FIELDWISE:
        raise ValueError(f"corruption {name!r} cannot be applied to one field; one of {FIELDWISE}")
    only = F.when(F.col("variable") == variable, _column(severity)).otherwise(0.0)
    return on_interior(df, only, lambda rows: CORRUPTIONS[kind](rows, only, seed), padded)


# --- analysis family: raw fields ----------------------------------------------------------------------------------------------


def disturb_blur(df: DataFrame, level, seed: int = 0) -> DataFrame:
    return _changed(df, level, lambda s: gaussian_blur("values", "h", "w", s))


def disturb_noise(df: DataFrame, level, seed: int = 0) -> DataFrame:
    """Independent noise of level * std, std being the variable's in column `std`."""

    def noisy(s: Column) -> Column:
        return F.transform(
            "values", lambda v, i: v + s * F.col("std") * normal(seed, "dnoise", F.col("sample_id"), F.col("variable"), i)
        )

    return _changed(df, level, noisy)


def disturb_grf(df: DataFrame, level, seed: int = 0) -> DataFrame:
    """Smoothed white noise, standardized over the field, times level * std."""
    white = F.transform("values", lambda v, i: normal(seed, "dgrf", F.col("sample_id"), F.col("variable"), i))

    def noisy(s: Column) -> Column:
        def added(smooth: Column) -> Column:
            return let(
                moments_of(smooth),
                lambda m: F.zip_with(
                    "values", smooth, lambda v, g: v + s * F.col("std") * (g - m["mean"]) / (m["std"] + 1e-8)
                ),
            )

        return let(gaussian_blur(white, "h", "w", F.lit(ANALYSIS_GRF_SIGMA)), added)

    return _changed(df, level, noisy)


def disturb_replace(df: DataFrame, level, seed: int = 0) -> DataFrame:
    """Replace exactly int(level * cells) cells by draws with the field's own mean and standard deviation.

    The cells with the smallest digests go; comparing with the last of them marks the cells in one pass.
    """
    key = (F.col("sample_id"), F.col("variable"))

    def replaced(s: Column) -> Column:
        def with_digests(digests: Column) -> Column:
            cut = F.get(F.sort_array(digests), F.floor(s * F.size(digests)).cast("int") - 1)
            state = F.struct(cut.alias("cut"), moments_of(F.col("values")).alias("m"))

            def fresh(c: Column, i: Column, st: Column) -> Column:
                return F.when(c["d"] <= st["cut"], st["m"]["mean"] + st["m"]["std"] * normal(seed, "dfresh", *key, i)).otherwise(c["v"])

            cells = F.arrays_zip(F.col("values").alias("v"), digests.alias("d"))
            return let(state, lambda st: F.transform(cells, lambda c, i: fresh(c, i, st)))

        return let(F.transform("values", lambda v, i: digest(seed, "dpick", *key, i)), with_digests)

    some = F.floor(_column(level) * F.size("values")) > 0
    return _changed(df, F.when(some, _column(level)).otherwise(0.0), replaced)


def disturb_patch(df: DataFrame, level, seed: int = 0, patch: int = ANALYSIS_PATCH) -> DataFrame:
    """Set int(level * patches) whole patches, those with the smallest digests, to the field mean."""
    h, w = F.col("h"), F.col("w")
    cols, rows = F.floor(w / patch).cast("int"), F.floor(h / patch).cast("int")
    n = rows * cols

    def dropped(s: Column) -> Column:
        def with_digests(digests: Column) -> Column:
            cut = F.get(F.sort_array(digests), F.floor(s * n).cast("int") - 1)
            hits = let(cut, lambda c: F.transform(digests, lambda d: d <= c))
            state = F.struct(hits.alias("hits"), mean_of(F.col("values")).alias("mean"))

            def cell(v: Column, i: Column, st: Column) -> Column:
                y, x = F.floor(i / w), i % w
                hit = F.get(st["hits"], (F.floor(y / patch) * cols + F.floor(x / patch)).cast("int"))
                return F.when((y < rows * patch) & (x < cols * patch) & hit, st["mean"]).otherwise(v)

            return let(state, lambda st: F.transform("values", lambda v, i: cell(v, i, st)))

        digests = F.transform(indices(n), lambda p: digest(seed, "dpatch", F.col("sample_id"), F.col("variable"), p))
        return let(digests, with_digests)

    some = F.floor(_column(level) * n) > 0
    return _changed(df, F.when(some, _column(level)).otherwise(0.0), dropped)


def disturb_quantize(df: DataFrame, levels, seed: int = 0) -> DataFrame:
    """Round to `levels` even steps between the field's ends (half to even). 256 or more, 0 or less, or a flat field: unchanged."""
    n = _column(levels)

    def stepped(a: Column) -> Column:
        ends = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))

        def rounded(e: Column) -> Column:
            span = e["hi"] - e["lo"]
            steps = F.transform(a, lambda v: F.rint((v - e["lo"]) / span * (n - 1)) / (n - 1) * span + e["lo"])
            return F.when(span != 0, steps).otherwise(a)

        return let(ends, rounded)

    return df.withColumn("values", F.when((n < 256) & (n > 0), let(F.col("values"), stepped)).otherwise(F.col("values")))


DISTURBANCES: dict[str, Callable[..., DataFrame]] = {
    "blur": disturb_blur,
    "noise": disturb_noise,
    "grf": disturb_grf,
    "replace": disturb_replace,
    "patch": disturb_patch,
    "quant": disturb_quantize,
}


def disturb(df: DataFrame, name: str, level, seed: int = 0) -> DataFrame:
    """Apply an analysis disturbance by any of its names; an unknown one leaves the data as it is."""
    fn = DISTURBANCES.get(DISTURBANCE_ALIASES.get(name, name))
    return df if fn is None else fn(df, level, seed)


def disturbance_sweep(df: DataFrame, levels: dict[str, Sequence[float]] | None = None, seed: int = 0, **options: dict) -> DataFrame:
    """Each row at every level of every disturbance: adds `disturbance` and `level`. Every disturbance is a branch of its own.

    `options` are those of single disturbances, such as patch={"patch": 4}. Noise needs the variable's `std`.
    """
    out = None
    for name, steps in (DISTURBANCE_LEVELS if levels is None else levels).items():
        swept = df.select("*", F.lit(name).alias("disturbance"), F.explode(F.array(*[F.lit(float(x)) for x in steps])).alias("level"))
        part = DISTURBANCES[name](swept, F.col("level"), seed, **options.get(name, {}))
        out = part if out is None else out.unionByName(part)
    return out


def canonical_disturbance(name: Column) -> Column:
    pairs = [F.lit(x) for kv in DISTURBANCE_ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name)


def disturbance_plan(requests: DataFrame) -> DataFrame:
    """(disturbance, held_out) from rows (name, held_out): canonical names, unknown ones dropped, each once."""
    known = requests.withColumn("disturbance", canonical_disturbance(F.col("name"))).where(
        F.col("disturbance").isin(list(DISTURBANCES))
    )
    return known.groupBy("disturbance").agg(F.max("held_out").alias("held_out"))


# --- random policies ----------------------------------------------------------------------------------------------------------


def power_severity(u: Column, max_severity: float, power: float) -> Column:
    """max * u^power; 0 when max <= 0."""
    if max_severity <= 0:
        return F.lit(0.0)
    if power <= 0:
        raise ValueError(f"severity power must be positive, got {power}")
    return max_severity * F.pow(u, F.lit(power))


def field_subset(samples: DataFrame, variables: Sequence[str], prob: float, seed: int = 0) -> DataFrame:
    """(sample_id, variable): each variable with probability `prob`, one drawn uniformly when none came up."""
    n = len(variables)
    names = F.array(*[F.lit(v) for v in variables])
    drawn = F.filter(names, lambda v: uniform(seed, "field", F.col("sample_id"), v) < prob)
    lone = F.array(F.get(names, F.floor(uniform(seed, "lone", F.col("sample_id")) * n).cast("int")))
    chosen = F.when(F.size(drawn) > 0, drawn).otherwise(lone)
    return samples.select("*", F.explode(chosen).alias("variable"))


def corruption_plan(
    samples: DataFrame,
    types: Sequence[str],
    variables: Sequence[str],
    max_severity: float = 1.0,
    power: float = 2.0,
    prob: float = 0.5,
    seed: int = 0,
    fixed: tuple[str, float] | None = None,
) -> DataFrame:
    """(sample_id, corruption, variable, severity). A fixed (type, severity) wins over the random policy.

    A fieldwise type gets its own severity for each drawn variable; a wind type gets one severity and variable null.
    """
    base = samples.select("sample_id")
    if fixed is not None and fixed[1] > 0:
        return base.select(
            "sample_id", F.lit(canonical_name(fixed[0])).alias("corruption"), F.lit(None).cast("string").alias("variable"),
            F.lit(float(fixed[1])).alias("severity"),
        )
    valid = [CORRUPTION_NAMES[t] for t in types if t in CORRUPTION_NAMES]
    if not valid:
        raise ValueError(f"no valid corruption in {list(types)}; one of {sorted(CORRUPTION_NAMES)}")
    kinds = F.array(*[F.lit(t) for t in valid])
    pick = F.get(kinds, F.floor(uniform(seed, "type", F.col("sample_id")) * len(valid)).cast("int"))
    chosen = base.withColumn("corruption", pick)
    each = F.col("corruption").isin(list(FIELDWISE))
    names = F.array(*[F.lit(v) for v in variables])
    drawn = F.filter(names, lambda v: uniform(seed, "field", F.col("sample_id"), v) < prob)
    lone = F.array(F.get(names, F.floor(uniform(seed, "lone", F.col("sample_id")) * len(variables)).cast("int")))
    fields = F.when(~each, F.array(F.lit(None).cast("string"))).when(F.size(drawn) > 0, drawn).otherwise(lone)
    out = chosen.withColumn("variable", F.explode(fields))
    u = uniform(seed, "severity", F.col("sample_id"), F.coalesce("variable", F.lit("all")))
    return out.withColumn("severity", power_severity(u, max_severity, power))


def apply_plan(df: DataFrame, plan: DataFrame, types: Sequence[str], seed: int = 0, patch: int = 16) -> DataFrame:
    """Corrupt each snapshot as its plan says: the rows of a corruption type take a branch of their own, no loop over samples."""
    per_sample = plan.groupBy("sample_id").agg(
        F.first("corruption").alias("_kind"),
        F.collect_list(F.struct("variable", "severity")).alias("_plan"),
    )
    mine = F.filter("_plan", lambda p: p["variable"].isNull() | (p["variable"] == F.col("variable")))
    planned = df.join(per_sample, "sample_id", "left").select(
        *df.columns, F.coalesce(F.get(mine, F.lit(0))["severity"], F.lit(0.0)).alias("_sev"), F.coalesce("_kind", F.lit("none")).alias("_kind")
    )
    kinds = list(dict.fromkeys(canonical_name(t) for t in types))
    rows = stored(planned, "_kind")  # a folder per type: each branch below reads its own rows only
    out = rows.where(~F.col("_kind").isin(kinds))
    for kind in kinds:
        options = {"patch": patch} if kind == "wind_patch_shuffle" else {}
        out = out.unionByName(CORRUPTIONS[kind](rows.where(F.col("_kind") == kind), F.col("_sev"), seed, **options))
    return out.select(*df.columns)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _changed(df: DataFrame, severity, change: Callable[[Column], Column]) -> DataFrame:
    s = _column(severity)
    return df.withColumn("values", F.when(s > 0, change(s)).otherwise(F.col("values")))
