import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.operators import compose, corrupt


def fields(df, variables="tuvp"):
    rows = {(r.sample_id, r.variable): np.array(r["values"], dtype=float).reshape(r.h, r.w) for r in df.collect()}
    n = len({k[0] for k in rows})
    return np.stack([np.stack([rows[(s, v)] for v in variables]) for s in range(n)])


def slow_blur(field, sigma):
    """Direct sum with mirrored edges, one axis after the other."""
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()

    def mirror(i, n):
        while i < 0 or i >= n:
            i = -i - 1 if i < 0 else 2 * n - 1 - i
        return i

    for axis in (0, 1):
        n = field.shape[axis]
        moved = np.moveaxis(field, axis, 0)
        out = np.stack([sum(t * moved[mirror(i + k, n)] for k, t in zip(range(-radius, radius + 1), taps)) for i in range(n)])
        field = np.moveaxis(out, 0, axis)
    return field


@pytest.mark.parametrize("sigma", [0.1, 0.7, 1.125, 5.0])
def test_blur_matches_direct_sum(snapshots, sigma):
    df, data = snapshots
    got = fields(corrupt.disturb_blur(df, sigma))
    want = np.stack([[slow_blur(f, sigma) for f in s] for s in data])
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_zero_severity_changes_nothing(snapshots):
    df, data = snapshots
    for name in corrupt.CORRUPTIONS:
        options = {"patch": 3} if name == "wind_patch_shuffle" else {}
        np.testing.assert_array_equal(fields(corrupt.corrupt(df, name, 0.0, **options)), data)
    with_std = df.withColumn("std", F.lit(1.0))
    for name in corrupt.DISTURBANCES:
        np.testing.assert_array_equal(fields(corrupt.disturb(with_std, name, 0 if name != "quant" else 256)), data)


def test_severity_may_differ_by_row(snapshots):
    df, data = snapshots
    got = fields(corrupt.noise(df, F.when(F.col("sample_id") == 1, 1.0).otherwise(0.0)))
    np.testing.assert_array_equal(got[[0, 2]], data[[0, 2]])
    assert (got[1] != data[1]).all()


def test_rotation_keeps_wind_speed_and_other_fields(snapshots):
    df, data = snapshots
    got = fields(corrupt.wind_rotation(df, 0.3))
    np.testing.assert_allclose(got[:, 1] ** 2 + got[:, 2] ** 2, data[:, 1] ** 2 + data[:, 2] ** 2, atol=1e-12)
    np.testing.assert_array_equal(got[:, [0, 3]], data[:, [0, 3]])
    quarter = fields(corrupt.wind_rotation(df, 1.0))
    np.testing.assert_allclose(quarter[:, 1], -data[:, 2], atol=1e-12)


def test_patch_shuffle_moves_whole_patches_together(snapshots):
    df, data = snapshots
    got = fields(corrupt.wind_patch_shuffle(df, 1.0, patch=2))
    assert not np.array_equal(got[:, 1:3], data[:, 1:3])
    np.testing.assert_array_equal(got[:, [0, 3]], data[:, [0, 3]])
    np.testing.assert_array_equal(got[:, :, :, 8], data[:, :, :, 8])  # the odd column is no whole patch
    for s in range(3):
        before = {tuple(data[s, 1:3, y : y + 2, x : x + 2].ravel()) for y in range(0, 6, 2) for x in range(0, 8, 2)}
        after = {tuple(got[s, 1:3, y : y + 2, x : x + 2].ravel()) for y in range(0, 6, 2) for x in range(0, 8, 2)}
        assert before == after
    same = fields(corrupt.wind_patch_shuffle(df, 0.1, patch=2))  # one patch chosen: nothing to permute
    np.testing.assert_array_equal(same, data)
    np.testing.assert_array_equal(fields(corrupt.wind_patch_shuffle(df, 1.0, patch=16)), data)


def test_partial_shuffle_touches_the_asked_number(snapshots):
    df, data = snapshots
    got = fields(corrupt.wind_patch_shuffle(df, 0.5, patch=2))
    for s in range(3):
        moved = sum(not np.array_equal(got[s, 1, y : y + 2, x : x + 2], data[s, 1, y : y + 2, x : x + 2]) for y in range(0, 6, 2) for x in range(0, 8, 2))
        assert moved <= 6


def big(spark, n=200, h=16, w=16):
    return spark.range(n).select(
        F.col("id").alias("sample_id"), F.lit("t").alias("variable"), F.lit(h).alias("h"), F.lit(w).alias("w"),
        F.array_repeat(F.lit(0.0), h * w).alias("values"),
    )


def test_noise_and_grf_have_the_asked_variance(spark):
    noisy = np.stack([r["values"] for r in corrupt.noise(big(spark), 2.0).collect()])
    assert abs(noisy.std() - 0.5) < 0.01 and abs(noisy.mean()) < 0.01
    field = np.stack([r["values"] for r in corrupt.grf(big(spark, 400), 2.0).collect()])
    assert abs(field.std() - 0.75) < 0.1
    grid = field.reshape(-1, 16, 16)
    assert np.corrcoef(grid[:, :, :-1].ravel(), grid[:, :, 1:].ravel())[0, 1] > 0.95


def test_pixel_replace_rate(spark):
    out = np.stack([r["values"] for r in corrupt.pixel_replace(big(spark), 1.0).collect()])
    assert abs((out != 0).mean() - 0.3) < 0.01


def test_disturb_replace_and_patch_counts(snapshots):
    df, data = snapshots
    got = fields(corrupt.disturb_replace(df, 0.5))
    assert ((got != data).sum(axis=(2, 3)) == 27).all()
    dropped = fields(corrupt.disturb_patch(df, 0.5, patch=3))
    assert ((dropped != data).sum(axis=(2, 3)) == 27).all()
    assert np.allclose(dropped[0, 0][dropped[0, 0] != data[0, 0]], data[0, 0].mean())


def test_quantize_levels(snapshots):
    df, data = snapshots
    got = fields(corrupt.disturb_quantize(df, 4))
    assert all(len(np.unique(np.round(f, 9))) <= 4 for s in got for f in s)
    assert np.allclose(got.min(axis=(2, 3)), data.min(axis=(2, 3)))
    flat = df.withColumn("values", F.transform("values", lambda v: F.lit(2.0)))
    assert (fields(corrupt.disturb_quantize(flat, 4)) == 2.0).all()


def test_names_and_refusals(snapshots):
    df, _ = snapshots
    assert {corrupt.canonical_name(n) for n in corrupt.CORRUPTION_NAMES} == set(corrupt.CORRUPTIONS)
    with pytest.raises(ValueError):
        corrupt.corrupt(df, "melt", 1.0)
    with pytest.raises(ValueError):
        corrupt.corrupt_fieldwise(df, "wind_rotation", "u", 1.0)
    with pytest.raises(ValueError):
        corrupt.ladder_sweep(df, ["melt"])
    with pytest.raises(ValueError):
        corrupt.power_severity(F.lit(0.5), 1.0, 0.0)
    with pytest.raises(ValueError):
        corrupt.corruption_plan(df, ["melt"], ["t"])


def test_plan_equals_single_corruptions(snapshots):
    df, _ = snapshots
    types = ["blur", "hf_noise", "pixel_replace", "wind_rotation", "wind_patch_shuffle"]
    samples = df.select("sample_id").distinct()
    plan = corrupt.corruption_plan(samples, types, list("tuvp"), 2.0, seed=4)
    got = fields(corrupt.apply_plan(df, plan, types, patch=3))
    base = fields(df)
    for r in plan.collect():
        options = {"patch": 3} if r.corruption == "wind_patch_shuffle" else {}
        if r.variable is None:
            want = fields(corrupt.corrupt(df, r.corruption, r.severity, **options))
            base[r.sample_id] = want[r.sample_id]
        else:
            want = fields(corrupt.corrupt_fieldwise(df, r.corruption, r.variable, r.severity))
            i = "tuvp".index(r.variable)
            base[r.sample_id, i] = want[r.sample_id, i]
    np.testing.assert_allclose(got, base, atol=1e-12)


def test_fixed_override_wins(snapshots):
    df, _ = snapshots
    plan = corrupt.corruption_plan(df.select("sample_id").distinct(), ["blur"], ["t"], fixed=("wind_rotated", 0.5)).collect()
    assert {(r.corruption, r.variable, r.severity) for r in plan} == {("wind_rotation", None, 0.5)} and len(plan) == 3


def test_pad_and_crop(snapshots):
    df, data = snapshots
    padded = df.withColumn("values", compose.pad_field(F.col("values"), F.col("h"), F.col("w")))
    got = fields(padded.withColumn("h", F.col("h") + 7).withColumn("w", F.col("w") + 16))
    want = np.pad(np.pad(data, [(0, 0), (0, 0), (4, 3), (0, 0)]), [(0, 0), (0, 0), (0, 0), (8, 8)], mode="wrap")
    np.testing.assert_array_equal(got, want)
    back = padded.withColumn("values", compose.crop_field(F.col("values"), F.col("h") + 7, F.col("w") + 16))
    np.testing.assert_array_equal(fields(back), data)
    cells = compose.pad_cells(compose.to_cells(df), 9).groupBy("sample_id", "variable", "y", "x").count()
    assert cells.count() == 3 * 4 * 6 * 25 and cells.where("count > 1").isEmpty()


def test_patchify_and_transpose(snapshots):
    df, data = snapshots
    tokens = {(r.sample_id, r.patch): r.token for r in compose.patchify(df, 3, list("tuvp")).collect()}
    for s in range(3):
        for p in range(6):
            y, x = p // 3 * 3, p % 3 * 3
            np.testing.assert_array_equal(tokens[(s, p)], data[s, :, y : y + 3, x : x + 3].ravel())
    turned = df.withColumn("values", compose.transpose_field(F.col("values"), F.col("h"), F.col("w")))
    got = {(r.sample_id, r.variable): np.array(r["values"]) for r in turned.collect()}
    np.testing.assert_array_equal(got[(1, "u")], data[1, 1].T.ravel())


def test_snapshots_and_cells_are_inverse(snapshots):
    df, data = snapshots
    cells = compose.to_cells(df).where("not (sample_id = 0 and variable = 't' and y = 2 and x = 3)")
    back = fields(compose.to_snapshots(cells.drop("h", "w"), 6, 9))
    assert np.isnan(back[0, 0, 2, 3])
    back[0, 0, 2, 3] = data[0, 0, 2, 3]
    np.testing.assert_array_equal(back, data)


def test_same_result_for_any_partitioning(snapshots):
    df, _ = snapshots
    one = fields(corrupt.pixel_replace(df.repartition(1), 1.0))
    many = fields(corrupt.pixel_replace(df.repartition(7, "variable"), 1.0))
    np.testing.assert_array_equal(one, many)


@pytest.mark.parametrize("sigma", [0.3, 1.125, 3.0])
def test_blur_around_gaps_and_infinities(spark, sigma):
    data = np.random.default_rng(8).normal(size=(4, 13, 17))
    data[0, 6, 8] = np.nan
    data[1, 0, 0], data[1, 12, 3] = np.nan, np.inf
    data[2, 4, 4], data[2, 4, 5] = np.inf, -np.inf
    rows = [(s, "t", 13, 17, [None if np.isnan(x) else float(x) for x in f.ravel()]) for s, f in enumerate(data)]
    df = spark.createDataFrame(rows, "sample_id long, variable string, h int, w int, values array<double>")
    with np.errstate(invalid="ignore"):
        want = np.stack([slow_blur(f, sigma) for f in data])
    got = {r.sample_id: np.array([np.nan if x is None else x for x in r["values"]]).reshape(13, 17) for r in corrupt.disturb_blur(df, sigma).collect()}
    for s in range(4):
        np.testing.assert_allclose(got[s], want[s], atol=1e-12)
    radius = int(4 * sigma + 0.5)
    assert np.isnan(got[0]).sum() == min(13, 2 * radius + 1) * min(17, 2 * radius + 1) and not np.isnan(got[3]).any()


def test_padded_fields_are_corrupted_inside(spark):
    rng = np.random.default_rng(3)
    inner = rng.normal(size=(2, 4, 6, 9))
    padded = np.pad(np.pad(inner, [(0, 0)] * 3 + [(8, 8)], mode="wrap"), [(0, 0)] * 2 + [(4, 3), (0, 0)])
    schema = "sample_id long, variable string, h int, w int, values array<double>, severity double"

    def frame(data):
        return spark.createDataFrame([(s, v, *data.shape[2:], data[s, i].ravel().tolist(), 0.6 * s) for s in range(2) for i, v in enumerate("tuvp")], schema)

    for name in ("blur", "hf_noise", "pixel_replace", "grf", "wind_rotation", "wind_shuffled"):
        options = {"patch": 3} if name == "wind_shuffled" else {}
        bare = fields(corrupt.corrupt(frame(inner), name, F.col("severity"), **options))
        got = fields(corrupt.corrupt(frame(padded), name, F.col("severity"), padded=(13, 25), **options))
        want = np.pad(np.pad(bare, [(0, 0)] * 3 + [(8, 8)], mode="wrap"), [(0, 0)] * 2 + [(4, 3), (0, 0)])
        np.testing.assert_array_equal(got, want)
        np.testing.assert_array_equal(got[0], padded[0])
    one = fields(corrupt.corrupt_fieldwise(frame(padded), "blur", "u", F.col("severity"), padded=(13, 25)))
    np.testing.assert_array_equal(one[:, [0, 2, 3]], padded[:, [0, 2, 3]])
    np.testing.assert_array_equal(one[:, 1], fields(corrupt.corrupt(frame(padded), "blur", F.col("severity"), padded=(13, 25)))[:, 1])
    whole = fields(corrupt.corrupt(frame(padded), "blur", F.col("severity")))  # not the model's size: blurred as it is
    assert not np.array_equal(whole[1, :, 3], padded[1, :, 3])


def test_sweep_routes_rows_by_type(snapshots):
    df, data = snapshots
    types = ["noise", "wind_rotation", "blur"]
    sweep = corrupt.ladder_sweep(df, [*types, "grf"], 3, 1.0)
    out = corrupt.apply_sweep(sweep, types)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "spectral_noise" not in plan  # only blur's rows meet Python
    got = {}
    for r in out.collect():
        got[r.corruption, r.severity, r.sample_id, r.variable] = np.array(r["values"]).reshape(r.h, r.w)
    assert len(got) == 4 * 3 * 12
    for kind in types:
        for severity in (0.0, 0.5, 1.0):
            alone = fields(corrupt.corrupt(df, kind, severity))
            for s in range(3):
                for i, v in enumerate("tuvp"):
                    np.testing.assert_allclose(got[kind, severity, s, v], alone[s, i], atol=1e-12)
    assert all(np.array_equal(got["grf", 1.0, s, v], data[s, i]) for s in range(3) for i, v in enumerate("tuvp"))
