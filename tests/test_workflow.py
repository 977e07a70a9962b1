import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldlab.functions.keyed import normal, uniform, uniform_value
from fieldlab.operators import assemble, catalog, compose, masks, scores, stats, tokens
from fieldlab.sources import archive, tables

ROWS, COLS = 8, 16


def samples(spark, n=40):
    return spark.range(n).select(F.floor(F.col("id") / 8).alias("batch"), F.col("id").alias("sample_id"))


def test_keyed_draws(spark):
    df = spark.range(20000).select(uniform("s", F.col("id")).alias("u"), normal("s", F.col("id")).alias("z"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev_pop("z")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] < r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.02
    assert spark.range(1).select(uniform("a", 3, F.lit(4))).first()[0] == uniform_value("a", 3, 4)


@pytest.mark.parametrize("disjoint", [False, True])
def test_masks(spark, disjoint):
    found = masks.target_masks(samples(spark), ROWS, COLS, disjoint=disjoint)
    found = masks.context_masks(found, ROWS, COLS).withColumnRenamed("context", "block")
    found = masks.world_band_masks(found, ROWS, COLS, scale=(0.5, 0.6))
    found = masks.visible_masks(found, ROWS * COLS, strict=False)
    rows = found.collect()
    for r in rows:
        hidden = {p for t in r.targets for p in t}
        assert len(r.targets) == 4 and all(len(t) > masks.MIN_KEEP and all(0 <= p < ROWS * COLS for p in t) for t in r.targets)
        assert not hidden & set(r.context) and not hidden & set(r.block)
        assert hidden | set(r.visible) == set(range(ROWS * COLS)) and not hidden & set(r.visible)
        assert sorted(hidden) == r.masked
        width = len({p % COLS for p in r.context})
        assert width <= 10
    for b in {r.batch for r in rows}:
        mine = [r for r in rows if r.batch == b]
        assert len({len(r.context) for r in mine}) == 1 and len({len(r.block) for r in mine}) == 1
        assert len({len(t) for r in mine for t in r.targets}) == 1
    if disjoint:
        apart = [len({p for t in r.targets for p in t}) == sum(len(t) for t in r.targets) for r in rows]
        assert all(apart)


def test_mask_errors(spark):
    with pytest.raises(PySparkException):
        masks.target_masks(samples(spark), ROWS, COLS, scale=(0.01, 0.02)).collect()  # a block of two patches
    found = masks.target_masks(samples(spark), ROWS, COLS)
    everything = found.withColumn("targets", F.array(F.sequence(F.lit(0), F.lit(127))))
    with pytest.raises(PySparkException):
        masks.world_band_masks(everything, ROWS, COLS).collect()
    with pytest.raises(PySparkException):
        masks.visible_masks(found, ROWS * COLS).collect()
    one = found.withColumn("targets", F.array(F.sequence(F.lit(0), F.lit(9))))
    assert masks.visible_masks(one, ROWS * COLS).where("size(visible) != 118").isEmpty()


def test_random_mask(spark):
    for r in masks.random_mask(samples(spark, 10), 20, 0.75).collect():
        assert len(r.keep) == 5 and sum(r.mask) == 15 and all(r.mask[p] == 0 for p in r.keep)
        assert [r.restore[p] for p in r.keep] == list(range(5)) and sorted(r.restore) == list(range(20))


def test_balanced_epoch(spark):
    for nr, nf in ((7, 20), (20, 7), (5, 5)):
        for augment in (False, True):
            rows = assemble.balanced_epoch(spark, nr, nf, augment).collect()
            k = max(nr, nf)
            assert sorted(r.slot for r in rows) == list(range(2 * k)) and sum(r.label for r in rows) == k
            for r in rows:
                n = nf if r.category in ("forecast", "corrupted_forecast") else nr
                assert r.idx == (r.slot % k) % n and (r.label == 1) == (r.slot < k) == (r.category == "real")
    with pytest.raises(ValueError):
        assemble.balanced_epoch(spark, 0, 4)


def test_eval_set(spark):
    real, fake = spark.range(5).withColumnRenamed("id", "idx"), spark.range(8).withColumnRenamed("id", "idx")
    plain = assemble.eval_set(real, fake).collect()
    assert sorted(r.slot for r in plain) == list(range(13)) and sum(r.label for r in plain) == 5
    assert sum(r.label for r in assemble.eval_set(real, fake, disturb_level=0.5).collect()) == 0
    assert all(r.label == 0 for r in assemble.eval_set(real, fake, augment_prob=0.5).collect() if r.corrupted)


def logits(spark, values, label=1):
    return spark.createDataFrame([(i, "s", 6, "c", label, float(x)) for i, x in enumerate(values)], "sample_id long, source string, lead_hours int, critic string, label int, logit double")


def test_reverse_kl(spark):
    x = logits(spark, [0.0, 0.0])
    r = scores.reverse_kl(x, x, ["lead_hours"]).first()
    assert r.score == 0.0 and r.stderr == 0.0
    v, q = [0.3, -1.2, 2.0], [-0.5, 0.1]
    r = scores.reverse_kl(logits(spark, v), logits(spark, q, 0), ["lead_hours"]).first()
    t, f = [-math.exp(min(-a, 50)) for a in v], [a - 1 for a in q]

    def err(a):
        m = sum(a) / len(a)
        return math.sqrt(sum((b - m) ** 2 for b in a) / (len(a) - 1) / len(a))

    assert abs(r.score - (sum(t) / 3 - sum(f) / 2)) < 1e-12 and abs(r.stderr - math.hypot(err(t), err(f))) < 1e-12
    assert scores.expectation(logits(spark, [2.5]), ["source"]).first().stderr == 0.0
    far = scores.expectation(logits(spark, [-1000.0]), ["source"], scores.reverse_kl_critic).first()
    assert abs(far["mean"] + math.exp(50)) < 1e9
    with pytest.raises(PySparkException):
        scores.reverse_kl(x.where("false"), x, ["lead_hours"]).collect()


def test_bce_and_topk(spark):
    df = logits(spark, [0.5, -2.0, 90.0]).unionByName(logits(spark, [1.0, -1.0], 0).withColumn("sample_id", F.col("sample_id") + 10))
    r = scores.bce_accuracy(df).first()
    want = [(0.5, 1), (-2.0, 1), (90.0, 1), (1.0, 0), (-1.0, 0)]
    loss = sum(math.log1p(math.exp(-v)) if y else math.log1p(math.exp(v)) for v, y in want) / 5
    assert abs(r.loss - loss) < 1e-9 and abs(r.accuracy - 0.6) < 1e-12
    top = {(t.category, t["rank"]): t.sample_id for t in scores.topk_samples(df, 2).collect()}
    assert top[("Realest", 1)] == 2 and top[("Most Uncertain", 1)] == 0 and top[("Best Fakes", 1)] == 10 and top[("Worst Fakes", 1)] == 11


def test_baseline_is_null_when_absent(spark):
    r = scores.baseline_curve(logits(spark, [1.0]), logits(spark, [1.0]).where("false")).first()
    assert r.base_mean is None and r.mean_logit == 1.0


def test_compose_errors(spark):
    df = spark.createDataFrame([("a", 1.0)], "variable string, value double")
    s = stats.field_stats(df)
    for mode, args in (("both", ()), ("diff", ()), ("phase", ()), ("concat", ())):
        with pytest.raises(ValueError):
            compose.compose(df, mode, ["a"], s, *args)


def test_catalog(spark):
    names = ["/d/Pangu_Weather_6steps_1.5deg_2018-01-01_2018-12-31.nc", "graphcast_6steps_surf_2020-01-01_2020-12-31.nc", "my2model-x_6steps.nc", "ERA5-forecast_6steps_2020-01-01_2020-06-30.nc", "/d/graphcast_6steps_2018-01-01_2018-12-31.nc"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: (r.label, r.start, r.end) for r in catalog.parse_files(files).collect()}
    assert got[names[0]] == ("Pangu-Weather", "2018-01-01", "2018-12-31")
    assert got[names[2]] == ("my2model-x".replace("-", " ").title(), None, None)
    pairs = catalog.temporal_pairs(files, "2018", "2020").collect()
    assert [(r.label, r.train, r.test) for r in pairs] == [("GraphCast", names[4], names[1])]
    pools = catalog.kfold_pools(files)
    assert pools.where("label = 'ERA5 Forecast'").isEmpty() and pools.where("holdout = label").isEmpty()
    assert pools.where(F.col("holdout") == catalog.FULL_POOL).count() == 4
    assert catalog.require_pool(pools, "GraphCast") is pools
    with pytest.raises(ValueError):
        catalog.require_pool(pools, "nobody")
    assert catalog.variable_tag(["t"]) == "t" and catalog.variable_tag(["t", "u"]) == "all_fields" and catalog.run_tag("a", None, "b") == "a_b"
    checkpoints = spark.createDataFrame([("c_exclude_IFS_HRES.pth",), ("c_exclude_Pangu-Weather.pth",), ("c_full_pool.pth",), ("c.pth",)], "n string")
    assert [r[0] for r in checkpoints.select(catalog.fold_label(F.col("n"))).collect()] == [None, "Excl: Pangu-Weather", "Full AI Pool", None]


def test_archive_round_trip_prunes(spark, tmp_path):
    rows = [(s, t, 6, v, float(i)) for s in ("ref", "m") for i, t in enumerate(["2019-05-01", "2020-05-01", "2021-05-01"]) for v in "ab"]
    df = spark.createDataFrame(rows, "source string, t string, lead_hours int, variable string, value double").select(
        "source", F.col("t").cast("timestamp_ntz").alias("init_time"), "lead_hours", F.lit(None).cast("int").alias("level"), "variable",
        F.lit(0).alias("y"), F.lit(1).alias("x"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.col("value").cast("float").alias("value"),
    )
    path = str(tmp_path / "archive")
    archive.write_cells(df, path)
    got = archive.read_cells(spark, path, ["ref"], ["a"], ["2020-01-01", "2020-12-31"])
    assert got.count() == 1 and got.first()["value"] == 1.0
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "source#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "variable" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert archive.read_cells(spark, path).count() == 12
    assert archive.list_files(spark, path, "*.parquet").count() >= 6


def test_stats_store(spark, tmp_path):
    path, calls = str(tmp_path / "stats"), []

    def compute():
        calls.append(1)
        return stats.field_stats(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "variable string, value double"))

    for again in (False, False, True):
        got = tables.load_or_compute_stats(spark, path, compute, recompute=again, mode="diff", delta_hours=24)
        assert got.first()["mean"] == 2.0
    assert len(calls) == 2
    assert tables.check_compatible(got, "diff", 24) is got
    for mode, step in (("none", None), ("diff", 6)):
        with pytest.raises(ValueError):
            tables.check_compatible(got, mode, step)
    old = got.drop("temporal_mode", "delta_hours")
    assert tables.check_compatible(old, "none", None) is old


def test_curve_store(spark, tmp_path):
    path = str(tmp_path / "curves")
    curve = spark.createDataFrame([("s", "noise", 0.0, 1.0, None, 4), ("s", "blur", 1.0, 2.0, 0.5, 4)], "metric string, series string, x double, value double, stderr double, n long")
    tables.save_curve(curve, path, {"kind": "v2", "ranges": [["2020-01-01", None]], "real_file": "a"})
    tables.save_curve(curve.limit(1), path, {"kind": "v1"})
    stored = spark.read.parquet(path)
    hit = tables.lookup_curve(stored, {"kind": "v2", "ranges": [["2020-01-01", None]], "real_file": "a"}, ["noise", "blur"])
    assert hit.count() == 2 and hit.where("stderr is null").isEmpty()
    assert tables.lookup_curve(stored, {"kind": "v3"}) is None
    assert tables.lookup_curve(stored, {"kind": "v1", "real_file": "a"}) is None  # provenance that was not recorded is stale
    assert tables.lookup_curve(stored, {"kind": "v1"}, ["noise", "blur"]) is None


def test_losses(spark):
    t = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [0.0, 0.0])], "sample_id long, patch int, token array<double>")
    p = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [9.0, 9.0])], "sample_id long, patch int, token array<double>")
    r = tokens.masked_l1(t, p, t.where("patch = 0").select("sample_id", "patch")).first()
    assert (r.masked_l1, r.n) == (1.5, 1)
    losses = spark.range(1).select(tokens.smooth_l1(F.lit(0.0), F.lit(0.5)), tokens.smooth_l1(F.lit(0.0), F.lit(3.0))).first()
    assert tuple(losses) == (0.125, 2.5)
