import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.functions import models
from fieldlab.operators import critic, distance, quantiles, spectra, tokens

SCHEMA = "sample_id long, g string, vec array<double>"


def frame(spark, x, g="x", start=0, parts=5):
    return spark.createDataFrame([(i + start, g, r.tolist()) for i, r in enumerate(x)], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6))
    return rng.normal(size=(90, 6)) @ mix, rng.normal(size=(70, 6)) @ mix * 1.3 + 0.5, rng.normal(size=(60, 6)) + 1000.0


def frechet_by_general_root(x, y):
    m1, m2, c1, c2 = x.mean(0), y.mean(0), np.cov(x, rowvar=False), np.cov(y, rowvar=False)
    root = np.sqrt(np.linalg.eigvals(c1 @ c2).astype(complex)).real.sum()
    return ((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * root


def lower_median_mmd(x, y):
    def d2(a, b):
        return ((a[:, None] - b[None]) ** 2).sum(-1)

    xx, yy, xy = d2(x, x), d2(y, y), d2(x, y)
    off = [m[~np.eye(len(m), dtype=bool)] for m in (xx, yy)]
    pool = np.sort(np.r_[off[0], off[1], xy.ravel()])
    gamma = 1 / (2 * pool[(len(pool) - 1) // 2] + 1e-6)
    n, m = len(x), len(y)
    k = [np.exp(-gamma * v).sum() for v in (off[0], off[1], xy)]
    return gamma, k[0] / (n * (n - 1)) + k[1] / (m * (m - 1)) - 2 * k[2] / (n * m)


def test_covariance(spark, sets, monkeypatch):
    monkeypatch.setattr(distance, "PIECE_DOUBLES", 13)  # two matrix rows per piece
    x, y, far = sets
    df = frame(spark, x, "x").unionByName(frame(spark, y, "y", 100)).unionByName(frame(spark, far, "far", 300))
    got = {(r.g, r.i): r for r in distance.covariance_rows(df, ["g"]).collect()}
    for name, data in (("x", x), ("y", y), ("far", far)):
        want = np.cov(data, rowvar=False)
        for i in range(6):
            np.testing.assert_allclose(got[(name, i)].row, want[i], rtol=1e-9)
            assert abs(got[(name, i)]["mean"] - data[:, i].mean()) < 1e-9 and got[(name, i)].n == len(data)


def test_covariance_of_one_vector_is_null(spark):
    rows = distance.covariance_rows(frame(spark, np.ones((1, 2))), ["g"]).collect()
    assert all(v is None for r in rows for v in r.row)


def test_frechet(spark, sets):
    x, y, _ = sets
    both = frame(spark, y, "y").unionByName(frame(spark, x, "same", 200))
    got = {r.g: r for r in distance.frechet(frame(spark, x), both, ["g"]).collect()}
    assert abs(got["y"].fid - frechet_by_general_root(x, y)) < 1e-8
    assert abs(got["same"].fid) < 1e-8 and got["y"].n == 70 and got["y"].n_ref == 90


def test_frechet_of_rank_deficient_sets(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(8, 12)), rng.normal(size=(9, 12))
    got = distance.frechet(frame(spark, x), frame(spark, y, "y"), ["g"], clamp=True).collect()[0].fid
    assert abs(got - frechet_by_general_root(x, y)) < 1e-5


@pytest.mark.parametrize("block_rows", [None, 7, 40])
def test_mmd_matches_brute_force(spark, sets, block_rows):
    x, y, _ = sets
    both = frame(spark, y, "y").unionByName(frame(spark, x[:30] + 0.1, "z", 200))
    got = {r.g: r for r in distance.mmd_rbf(frame(spark, x), both, "g", "sample_id", block_rows=block_rows).collect()}
    for name, other in (("y", y), ("z", x[:30] + 0.1)):
        gamma, value = lower_median_mmd(x, other)
        assert abs(got[name].gamma - gamma) < 1e-9 * gamma + 1e-12
        assert abs(got[name].mmd - value) < 1e-10


def test_median_takes_two_counting_passes(spark, sets, monkeypatch):
    x, y, _ = sets
    passes, per_tile = [], distance._per_tile
    monkeypatch.setattr(distance, "_per_tile", lambda *given: passes.append(1) or per_tile(*given))
    grid, _ = distance.tiles(frame(spark, x), frame(spark, y, "y"), "g", "sample_id")
    assert dict(grid.dtypes)["a"] == "binary"
    gamma = distance.mmd_gammas(grid).collect()[0].gamma
    assert abs(gamma - lower_median_mmd(x, y)[0]) < 1e-9 * gamma and len(passes) <= 2


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_median_of_ties_and_after_a_wrong_guess(spark, few, monkeypatch):
    monkeypatch.setattr(distance, "SAMPLE", 1)  # the guess commonly misses the rank
    monkeypatch.setattr(distance, "FEW", few)
    rng = np.random.default_rng(8)
    for x, y in ((rng.integers(0, 2, (60, 3)), rng.integers(0, 2, (50, 3))), (np.ones((40, 2)), np.r_[np.ones((9, 2)), np.zeros((2, 2))]), (rng.normal(size=(50, 2)), rng.normal(size=(40, 2)) ** 9)):
        x, y = x.astype(float), y.astype(float)
        got = distance.mmd_rbf(frame(spark, x), frame(spark, y, "y"), "g", "sample_id", block_rows=13).collect()[0]
        gamma, value = lower_median_mmd(x, y)
        assert abs(got.gamma - gamma) < 1e-9 * gamma and abs(got.mmd - value) < 1e-10


@pytest.mark.parametrize("size", [2, 3, 9])
def test_pairs_far_from_a_bracket_are_counted_by_leaves(size):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(1000, size)), rng.normal(size=(777, size)) * 1.5 + 0.3
    x, y = x[distance._order(x)], y[distance._order(y)]
    for other in (y, None):
        d = ((x[:, None] - (x if other is None else y)[None]) ** 2).sum(-1)
        d[np.tri(*d.shape, dtype=bool) if other is None else np.zeros(d.shape, bool)] = np.inf
        lo, hi = np.quantile(d[d < np.inf], [0.495, 0.505]) + 1e-9
        pairs = distance._Pairs(len(x), x.tobytes(), None if other is None else len(y), None if other is None else y.tobytes())
        below, inside = 0, []
        for known, row, columns, part in pairs.parts(lo, hi):
            below += known
            if part is not None:
                at = np.flatnonzero((part >= np.float32(lo - pairs.slip)) & (part <= hi + pairs.slip))
                exact = pairs.exact(row, columns, at)
                below += np.count_nonzero(part < np.float32(lo - pairs.slip)) + np.count_nonzero(exact < lo)
                inside.append(exact[(exact >= lo) & (exact <= hi)])
        np.testing.assert_allclose(np.sort(np.concatenate(inside)), np.sort(d[(d >= lo) & (d <= hi)]), rtol=1e-12)
        assert below == np.count_nonzero(d < lo) and pairs.size == np.count_nonzero(d < np.inf)
        assert pairs.open < (0.8 if size == 2 else 1.0) * pairs.size if size < 4 else pairs.open == pairs.size


@pytest.mark.parametrize("size", [3, 20])
def test_a_survey_takes_an_even_share_of_the_pairs(size):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(3000, size)), rng.normal(size=(2500, size)) * 1.2 + 0.3
    x, y = x[distance._order(x)], y[distance._order(y)]
    d = ((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T).ravel()
    middle, seen, below, known = np.median(d), 0, 0, 0
    pairs = distance._Pairs(len(x), x.tobytes(), len(y), y.tobytes())
    for whole, _, _, part in pairs.parts(middle * 0.97, middle * 1.03, 4):
        known += whole
        if part is not None:
            seen, below = seen + np.count_nonzero(part < np.inf), below + np.count_nonzero(part < middle)
    assert abs(seen / pairs.open - 0.25) < 0.01
    assert abs(known + below * pairs.open / seen - d.size / 2) < 6 * np.sqrt(seen) * pairs.open / seen


def test_kernel_of_few_components_needs_no_pairs():
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(300, 3)), rng.normal(size=(200, 3))
    width = 1 / (2 * np.median(((x[:, None] - y[None]) ** 2).sum(-1)))
    assert (distance._rest(x, y, False, np.array([width]), np.sqrt(2 * width)) == 0).all()


@pytest.mark.parametrize("size", [3, 40])
def test_mmd_with_vectors_far_off(spark, size):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(150, size)) + 5, rng.normal(size=(120, size)) * 1.2 + 5
    x[0] *= 3
    x[1:3] *= -30
    y[:2] *= 1e5
    got = {r.g: r for r in distance.mmd_rbf(frame(spark, x), frame(spark, y, "y").unionByName(frame(spark, y * 1e-3, "z", 500)), "g", "sample_id", block_rows=60).collect()}
    for name, other in (("y", y), ("z", y * 1e-3)):
        gamma, value = lower_median_mmd(x, other)
        assert abs(got[name].gamma - gamma) < 1e-9 * gamma and abs(got[name].mmd - value) < 1e-10


def test_mmd_with_given_gamma_and_duplicates(spark):
    x = np.ones((20, 3))
    got = distance.mmd_rbf(frame(spark, x), frame(spark, x, "y"), "g", "sample_id", gamma=0.5).collect()[0]
    assert abs(got.mmd) < 1e-12


def test_mmd_of_a_single_vector_is_null(spark, sets):
    x, y, _ = sets
    got = distance.mmd_rbf(frame(spark, x), frame(spark, y[:1], "y"), "g", "sample_id").collect()[0]
    assert got.mmd is None and got.n == 1 and got.gamma > 0


def test_sqdist_summary(spark, sets):
    x, y, _ = sets
    rows = {r.kind: r for r in distance.sqdist_summary(frame(spark, x), frame(spark, y, "y"), "g", "sample_id", 16).collect()}
    d = ((x[:, None] - y[None]) ** 2).sum(-1)
    assert rows["cross"].n == d.size and abs(rows["cross"]["mean"] - d.mean()) < 1e-9 and abs(rows["cross"]["max"] - d.max()) < 1e-9
    assert rows["ref"].n == 90 * 89


def test_quantiles_with_infinities(spark):
    data = {"up": [float(i) for i in range(100)] + [math.inf], "both": [-math.inf, 1.0, 2.0, math.inf, math.inf], "flat": [3.0] * 4, "none": [math.inf] * 2}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = {(r.g, r.prob): r.quantile for r in quantiles.exact_quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    for g, vs in data.items():
        ordered = sorted(vs)
        for p in (0.0, 1.0):
            assert got[(g, p)] == ordered[int(p * (len(vs) - 1))]
    assert [got[(g, 0.5)] for g in data] == [50.0, 2.0, 3.0, math.inf]


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    data = {"a": np.exp(rng.normal(size=999) * 6), "b": np.r_[np.zeros(500), rng.normal(size=3)], "c": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "g string, v double")
    got = {(r.g, r.prob): r.quantile for r in quantiles.exact_quantiles(df, ["g"], "v", [0.01, 0.5, 0.99]).collect()}
    for (g, p), q in got.items():
        assert abs(q - np.quantile(data[g], p)) <= 1e-12 * abs(q) + 1e-300
    assert quantiles.lower_median(df, ["g"], "v")[("a",)] == np.sort(data["a"])[499]
    with_nan = df.unionByName(spark.createDataFrame([("c", float("nan")), ("c", None)], "g string, v double"))
    assert quantiles.lower_median(with_nan, ["g"], "v")[("c",)] == 4.0


def test_display_limits(spark):
    df = spark.createDataFrame([("u", float(v)) for v in range(-50, 21)], "g string, v double")
    r = quantiles.display_limits(df, ["g"], "v", 0.0, 1.0, F.col("g") == "u").collect()[0]
    assert (r.lo, r.hi) == (-50.0, 50.0)


def test_spectra_match_numpy(snapshots):
    df, data = snapshots
    got = {(r.source, r.variable, r.ky, r.kx): r.log_power for r in spectra.psd_2d(df).collect()}
    radial = {(r.source, r.variable, r.k): r.log_power for r in spectra.psd_radial(df).collect()}

    def power(f):
        p = np.abs(np.fft.fftshift(np.fft.fft2(f - f.mean()))) ** 2
        p[3, 4] = 0.0
        return p

    want = np.mean([np.log10(power(data[s, 1]) + 1e-8) for s in (1, 2)], axis=0)
    for ky in range(6):
        for kx in range(9):
            assert abs(got[("ref", "u", ky, kx)] - want[ky, kx]) < 1e-9
    ring = np.rint(np.hypot(np.arange(6)[:, None] - 3, np.arange(9)[None] - 4)).astype(int)
    for k in range(3):
        logs = [np.log10(power(data[s, 1])[ring == k].mean() + 1e-10) for s in (1, 2)]
        assert abs(radial[("ref", "u", k)] - np.mean(logs)) < 1e-9
    assert ("ref", "u", 3) not in radial


def test_histogram_density_sums_to_one(snapshots):
    df, data = snapshots
    rows = spectra.psd_histogram(df, edges=10).where("variable = 't' and source = 'ref'").collect()
    assert abs(sum(r.density * (r.right - r.left) for r in rows) - 1) < 1e-9 and sum(r.n for r in rows) == 2 * 53
    mags = [np.abs(np.fft.fft2(f - f.mean())).ravel()[1:] for f in data[:, 0]]
    edges = np.logspace(np.log10(np.min(mags)), np.log10(np.max(mags)), 10)
    want, _ = np.histogram(np.clip(np.r_[mags[1], mags[2]], edges[0], edges[-1]), edges)
    got = dict.fromkeys(range(9), 0) | {r.bin: r.n for r in rows}
    assert [got[i] for i in range(9)] == want.tolist()


def test_pca_matches_svd(spark, sets):
    x, _, _ = sets
    rows = sorted(distance.pca_2d(frame(spark, x)).collect(), key=lambda r: r.sample_id)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for j, name in enumerate(("pc1", "pc2")):
        got = np.array([r[name] for r in rows])
        want = u[:, j] * s[j]
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8


def test_probe_matches_least_squares(spark, sets):
    x, _, _ = sets
    y = x @ np.arange(6) + np.sin(np.arange(90))
    df = frame(spark, x).join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "sample_id long, severity double"), "sample_id")
    scored = distance.predict_probe(distance.fit_probe(df), df)
    got = distance.probe_metrics(scored, ["g"], "severity", "prediction").collect()[0]
    a = np.c_[x, np.ones(90)]
    pred = a @ np.linalg.lstsq(a, y, rcond=None)[0]
    mse = ((pred - y) ** 2).mean()
    assert abs(got.mse - mse) < 1e-8 and abs(got.r2 - (1 - mse / y.var(ddof=1))) < 1e-9
    slope, intercept = np.polyfit(y, pred, 1)
    assert abs(got.slope - slope) < 1e-8 and abs(got.intercept - intercept) < 1e-8
    flat = df.withColumn("severity", F.lit(1.0)).withColumn("prediction", F.lit(0.0))
    assert distance.probe_metrics(flat, ["g"], "severity", "prediction").collect()[0].r2 == 0.0


def test_pooling_and_encoder(spark, snapshots):
    df, data = snapshots
    basis = np.random.default_rng(5).normal(size=(4, 36))
    want = np.stack([[basis @ data[s, :, y : y + 3, x : x + 3].ravel() for y in (0, 3) for x in (0, 3, 6)] for s in range(3)])
    for kind, pooled in (("mean", want.mean(1)), ("max", want.max(1)), ("concat", np.c_[want.mean(1), want.max(1)])):
        got = {r.sample_id: r.vec for r in tokens.extract_features(df, 3, list("tuvp"), basis.tolist(), pool=kind).collect()}
        np.testing.assert_allclose([got[s] for s in range(3)], pooled, atol=1e-12)
    with pytest.raises(ValueError):
        tokens.pool_array(F.col("x"), "median")
    flat = df.groupBy("sample_id").agg(F.first("values").alias("vec"))
    encode = models.encoder(spark, basis[:, :2], lambda m, x: x[:, :4] @ m)
    assert len(flat.select(encode(F.col("vec")).alias("z")).first().z) == 2
    score = models.critic(spark, 2.0, lambda m, x: m * x[:, 0])
    rows = critic.score_critic(flat, {"net": score, "lin": ([0.0] * 54, 1.5)}).collect()
    assert {r.critic for r in rows} == {"net", "lin"} and all(r.logit == 1.5 for r in rows if r.critic == "lin")
    grown = tokens.extract_features(df, 3, list("tuvp"), basis.tolist(), transform_fn=lambda d: d.withColumn("values", F.transform("values", lambda v: v * 2)))
    np.testing.assert_allclose(sorted(grown.collect())[1].vec, 2 * want.mean(1)[1], atol=1e-12)


def test_fit_critic_separates(spark, sets):
    x, y, _ = sets
    df = frame(spark, x).withColumn("label", F.lit(1)).unionByName(frame(spark, y + 3, "y", 500).withColumn("label", F.lit(0)))
    fitted = critic.fit_folds(critic.pooled_folds(df.withColumnRenamed("g", "model"), {"a": ["y"], "b": ["y"]}))
    both = {r.fold: r for r in fitted.collect()}
    assert both["a"].weights == both["b"].weights and both["a"].n == 160
    scored = critic.score_folds(df, fitted, lambda fold: fold == "a")
    right = scored.where((F.col("logit") > 0).cast("int") == F.col("label")).count()
    assert right > 0.8 * scored.count() and {r.critic for r in scored.collect()} == {"a"}
    with pytest.raises(ValueError):
        critic.pooled_folds(df.withColumnRenamed("g", "model"), {"a": []})


def test_folds_fitted_together_equal_single_fits(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(240, 3))
    models = ["real" if i % 2 else "abc"[i // 2 % 3] for i in range(240)]
    y = np.array([1.0 if m == "real" else 0.0 for m in models])
    x[y == 1] += 0.4
    rows = [(i, m, int(t), v.tolist()) for i, (m, t, v) in enumerate(zip(models, y, x))]
    df = spark.createDataFrame(rows, "sample_id long, model string, label int, vec array<double>").repartition(7)
    got = {r.fold: r for r in critic.fit_folds(critic.left_out_folds(df), reg=0.05).collect()}
    assert set(got) == {"a", "b", "c", "full_pool"}
    for fold, r in got.items():
        use = np.array([m != fold for m in models])
        xs, ys, w = np.hstack([x[use], np.ones((use.sum(), 1))]), y[use], np.zeros(4)
        ridge = np.array([0.05, 0.05, 0.05, 0.0])
        for _ in range(20000):  # plain gradient descent
            w -= 0.5 * (xs.T @ (1 / (1 + np.exp(-xs @ w)) - ys) / len(ys) + ridge * w)
        np.testing.assert_allclose([*r.weights, r.intercept], w, atol=1e-7)
        assert r.n == use.sum()


def test_moments_merge_as_a_deep_tree(spark, sets, monkeypatch):
    monkeypatch.setattr(distance, "FAN_IN", 2)
    monkeypatch.setattr(distance, "STATE_DOUBLES", 1)  # every batch is handed over
    x, y, _ = sets
    df = frame(spark, x, "x", parts=9).unionByName(frame(spark, y, "y", 100, parts=4))
    got = {(r.g, r.i): r for r in distance.covariance_rows(df, ["g"]).collect()}
    for name, data in (("x", x), ("y", y)):
        for i in range(6):
            np.testing.assert_allclose(got[(name, i)].row, np.cov(data, rowvar=False)[i], rtol=1e-9)


def test_closed_forms_for_two_components(spark):
    rng = np.random.default_rng(21)
    x, y = rng.normal(size=(50, 2)) @ [[2.0, 0.7], [0.0, 0.5]], rng.normal(size=(40, 2)) @ [[0.3, -0.4], [0.1, 1.0]] + 2
    line = np.outer(rng.normal(size=30), [1.0, 2.0])  # covariance without inverse
    cand = frame(spark, y, "y").unionByName(frame(spark, line, "line", 200)).unionByName(frame(spark, x, "same", 400))
    plane = {r.g: r.fid for r in distance.frechet_plane(frame(spark, x), cand, ["g"]).collect()}
    whole = {r.g: r.fid for r in distance.frechet(frame(spark, x), cand, ["g"]).collect()}
    assert all(abs(plane[g] - whole[g]) < 1e-6 for g in ("y", "line", "same")) and abs(plane["y"] - frechet_by_general_root(x, y)) < 1e-8
    for data in (x, y, line):
        a = {r.sample_id: (r.pc1, r.pc2) for r in distance.pca_plane(frame(spark, data)).collect()}
        b = {r.sample_id: (r.pc1, r.pc2) for r in distance.pca_2d(frame(spark, data)).collect()}
        np.testing.assert_allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(b)], atol=1e-8)


def test_tiles_of_many_strips(spark, sets):
    x, y, _ = sets
    grid, sizes = distance.tiles(frame(spark, x), frame(spark, y, "y"), "g", "sample_id", block_rows=20)
    strips = {r.set: r.strips for r in sizes.collect()}
    kinds = {k: grid.where(F.col("kind") == k).count() for k in ("ref", "cand", "cross")}
    assert strips == {"ref": 5, "cand": 4} and kinds == {"ref": 15, "cand": 10, "cross": 20}


def test_histogram_of_arrays(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(30, 6, 6))
    data[0] = 1.0  # a flat field has no power at all
    rows = [(i, "ab"[i % 2], "v", 6, 6, f.ravel().tolist()) for i, f in enumerate(data)]
    df = spark.createDataFrame(rows, "sample_id long, source string, variable string, h int, w int, values array<double>").repartition(5)
    got = {(r.source, r.bin): r for r in spectra.psd_histogram(df, edges=11).collect()}
    power = np.abs(np.fft.fft2(data - data.mean((1, 2), keepdims=True)))
    power[:, 0, 0] = 0
    power[0] = 0
    logs = [np.log10(power[i::2][power[i::2] > 0]) for i in range(2)]
    lo, hi = min(m.min() for m in logs), max(m.max() for m in logs)
    for k, m in enumerate(logs):
        n = np.bincount(np.minimum(((m - lo) / ((hi - lo) / 10)).astype(int), 9), minlength=10)
        assert {b: int(c) for b, c in enumerate(n) if c} == {b: r.n for (s, b), r in got.items() if s == "ab"[k]}
    mean = {(r.source, r.ky, r.kx): r.log_power for r in spectra.psd_2d(df).collect()}
    want = np.fft.fftshift(np.log10(power[1::2] ** 2 + 1e-8).mean(0))
    np.testing.assert_allclose([mean["b", y, x] for y in range(6) for x in range(6)], want.ravel(), atol=1e-9)
