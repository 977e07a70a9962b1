import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldlab.functions import times
from fieldlab.operators import compose, pairing, ranking, select, stats
from fieldlab.sources import archive

T0 = dt.datetime(2020, 1, 1)


def cells(spark, n=40, step=6, sources=("ref", "m1"), leads=(0, 6, 24), skip=()):
    rows = [
        (s, T0 + dt.timedelta(hours=step * i), lead, v, y, x, float(i + 10 * y + 100 * x + lead) + (0.5 if v == "b" else 0.0))
        for s in sources for i in range(n) if i not in skip for lead in leads for v in "ab" for y in range(2) for x in range(2)
    ]
    df = spark.createDataFrame(rows, "source string, init_time timestamp_ntz, lead_hours int, variable string, y int, x int, value double")
    return df.withColumn("lat", F.col("y") * 1.0).withColumn("lon", F.col("x") * 1.0)


def test_position_is_a_global_rank(spark):
    rng = np.random.default_rng(0)
    days = rng.integers(0, 50, 700)
    df = spark.createDataFrame([("a" if i % 3 else "b", i, int(d)) for i, d in enumerate(days)], "g string, id int, day int")
    got = ranking.position(df, ["day", "id"], F.col("day"), ["g"]).collect()
    for g in "ab":
        mine = sorted((r.day, r.id, r.position) for r in got if r.g == g)
        assert [m[2] for m in mine] == list(range(len(mine)))
    everyone = ranking.random_position(df, [1, F.col("id")]).collect()
    assert sorted(r.position for r in everyone) == list(range(700))


@pytest.mark.parametrize("n, k", [(10, 3), (40, 7), (40, 40), (5, 9), (33, 1), (40, 0), (37, 13)])
def test_even_subsample_is_linspace(spark, n, k):
    df = cells(spark, n, sources=("ref",), leads=(0,))
    got = [r[0] for r in select.even_subsample(df, k).select("init_time").distinct().orderBy("init_time").collect()]
    index = range(n) if k == 0 or n <= k else np.linspace(0, n - 1, k, dtype=int)
    assert got == [T0 + dt.timedelta(hours=6 * int(i)) for i in index]


def test_ranges(spark):
    df = cells(spark, 20, sources=("ref",), leads=(0,)).where("variable = 'a' and y = 0 and x = 0")
    assert select.select_time_ranges(df, None).count() == 20
    assert select.select_time_ranges(df, ["2020-01-02", "2020-01-02"]).count() == 4  # a date end covers its day
    assert select.select_time_ranges(df, ["2020-01-02", "2020-01-02 06:00:00"]).count() == 2
    assert select.select_time_ranges(df, [["2020-01-02", None], [None, "2020-01-02"]]).count() == 24  # overlap twice
    assert select.select_time_ranges(df, [["2020-01-01", "2020-01-01"], ["2020-01-03", "2020-01-03"]]).count() == 8
    assert select.select_time_ranges(df, ["2021-01-01", None]).isEmpty()
    with pytest.raises(ValueError):
        select.select_time_ranges_strict(df, ["2021-01-01", None])
    plan = select.select_time_ranges(df, [["2020-01-02", None], [None, "2020-01-02"]])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan


def test_overlap_check():
    select.check_no_overlap(["2018-01-01", "2018-12-31"], [["2019-01-01", None], [None, "2017-12-31"]])
    for test in (["2018-12-31", None], [None, None], [["2017-01-01", "2018-01-01"]]):
        with pytest.raises(ValueError):
            select.check_no_overlap(["2018-01-01", "2018-12-31"], test)
    assert select.as_ranges([]) == [] and len(select.as_ranges([["2020-01-01", None], ["2021-01-01", "2021-02-01"]])) == 2


def test_fallback_and_leads(spark):
    df = cells(spark, 8).where("source = 'ref' or init_time < '2020-01-01 12:00:00'")
    out = select.range_fallback(df, ["2020-01-02", None])
    assert out.where("source = 'ref'").select("init_time").distinct().count() == 4
    assert out.where("source = 'm1'").select("init_time").distinct().count() == 2
    assert {r.lead_hours for r in select.filter_leads(df, None).select("lead_hours").distinct().collect()} == {6, 24}
    assert {(r.source, r.lead_hours) for r in select.missing_leads(df, [6, 48]).collect()} == {("ref", 48), ("m1", 48)}
    chosen = select.zero_lead(df.where("source = 'ref' or lead_hours > 0")).select("source", "lead_hours").distinct().collect()
    assert {tuple(r) for r in chosen} == {("ref", 0), ("m1", 6)}


def test_variables(spark):
    df = cells(spark, 2)
    assert select.select_variables(df, None, "a").select("variable").distinct().count() == 1
    assert select.require_variables(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="m1/c"):
        select.require_variables(df, ["a", "c"])
    assert select.missing_variables(df, ["a", "c"]).count() == 2
    filled = stats.add_missing_channels(df.where("not (variable = 'b' and x = 1)"), ["a", "b", "c"])
    assert filled.where("variable = 'c' and value = 0").count() == filled.where("variable = 'a'").count() == 48
    assert filled.where("variable = 'b' and x = 1 and value = 0").count() == 24


def test_splits(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    halves = select.split_halves(df, "k", 5).collect()
    assert len(halves) == 10 == len({r.k for r in halves}) and sum(r.half == "a" for r in halves) == 5
    parts = select.random_split(df, "k", 0.8, 5).collect()
    assert sum(r.split == "train" for r in parts) == 8 and len(parts) == 11
    lone = select.random_split(df.where("k = 3"), "k").collect()
    assert sorted(r.split for r in lone) == ["test", "train"]  # test falls back to train
    assert select.cap_random(df, "k", 4).count() == 4 and select.cap_random(df, "k", 40).count() == 11
    timed = select.time_split(cells(spark, 10, sources=("ref",), leads=(0,)), 0.75, delta=2)
    first = {r.split: (r.lo, r.n) for r in timed.groupBy("split").agg(F.min("init_time").alias("lo"), F.countDistinct("init_time").alias("n")).collect()}
    assert first["train"] == (T0 + dt.timedelta(hours=12), 5) and first["val"] == (T0 + dt.timedelta(hours=54), 1)


def test_reference_pool(spark):
    ref = cells(spark, 40, sources=("ref",), leads=(0,))
    fc = cells(spark, 3, step=12, sources=("m1",), leads=(6,)).withColumn("init_time", times.shift_hours(F.col("init_time"), 24))
    near = select.reference_pool(ref, fc).select("init_time").distinct().orderBy("init_time").collect()
    assert [r[0] for r in near] == [T0 + dt.timedelta(hours=h) for h in (24, 36, 48)]
    every = select.reference_pool(ref, fc, restrict_dates=False).select("init_time").distinct()
    assert every.count() == 20


def test_index_scans(spark):
    df = cells(spark, 10)
    assert archive.index_slice(df, 2, 5).select("init_time").distinct().count() == 3
    wanted = spark.createDataFrame([("ref", 1), ("ref", 9), ("m1", 0)], "source string, t_idx long")
    got = archive.at_indices(df, wanted).select("source", "init_time").distinct().collect()
    assert len(got) == 3
    late = archive.forecast_at_lead(df, 24)
    assert late.where("valid_time != init_time + interval 24 hours").isEmpty() and not late.isEmpty()
    with pytest.raises(ValueError):
        archive.forecast_at_lead(df.drop("lead_hours"), 24)
    kept, missing = archive.extract_archive(df, ["a"], ["2020-01-01", "2020-01-01"], [6, 48])
    assert kept.count() == 2 * 4 * 4 and {r.lead_hours for r in missing.collect()} == {48}
    for args in ((["z"], None, None), (["a"], ["2030-01-01", None], None)):
        with pytest.raises(ValueError):
            archive.extract_archive(df, *args)
    with pytest.raises(ValueError):
        archive.extract_forecast(df, ["a"], None, 48)
    with pytest.raises(ValueError):
        archive.extract_forecast(df, ["a"], ["2030-01-01", None], 24)


def test_cf_times(spark):
    rows = [(1.5, "hours since 2000-01-01 06:00:00"), (2.0, "days since 1999-12-31"), (-90.0, "Minutes since 2000-01-01"), (1e9, "seconds since 1970-01-01"), (1.0, "fortnights since 2000-01-01")]
    df = spark.createDataFrame(rows, "v double, u string")
    got = [r[0] for r in df.select(times.decode_cf(F.col("v"), F.col("u"))).collect()]
    want = [dt.datetime(2000, 1, 1, 1, 30), dt.datetime(2000, 1, 2), dt.datetime(1999, 12, 31, 22, 30), dt.datetime(2001, 9, 9, 1, 46, 40), dt.datetime(2000, 1, 2)]
    assert got == want
    spans = spark.sql("SELECT INTERVAL '1 06:59:59' DAY TO SECOND AS d")
    assert spans.select(times.lead_to_hours(F.col("d"))).first()[0] == 30


def test_prior_by_index_and_diff_stats(spark):
    df = cells(spark, 12, skip=(4, 5))
    pairs = pairing.prior_by_index(df, 2).collect()
    axis = [i for i in range(12) if i not in (4, 5)]
    expected = {T0 + dt.timedelta(hours=6 * axis[j]): T0 + dt.timedelta(hours=6 * axis[j - 2]) for j in range(2, len(axis))}
    assert len(pairs) == 8 * 2 * 3 * 2 * 4 and all(expected[r.init_time] == r.prior_time for r in pairs)
    rows = {r.variable: r for r in stats.diff_stats(cells(spark, 12), 3).collect()}
    assert abs(rows["a"]["mean"] - 3) < 1e-12 and rows["a"]["std"] == 1.0  # constant differences: a zero std counts as 1
    with pytest.raises(ValueError):
        stats.diff_stats(df, 0)


def test_exact_prior(spark):
    df = cells(spark, 6, sources=("ref",), leads=(0,)).where("variable = 'a' and y = 0 and x = 0")
    assert pairing.prior_exact(df, df, 12, ["source"], "init_time", "value").count() == 4
    assert pairing.prior_dropped(df, df, 12, ["source"], "init_time").count() == 2


def nearest(left, right, tolerance):
    out = {}
    for lid, t in left:
        best = min(((abs((rt - t).total_seconds()), rt, rid) for rid, rt in right), default=None)
        if best and (tolerance is None or best[0] <= tolerance * 3600):
            out[lid] = (best[2], best[0])
    return out


@pytest.mark.parametrize("tolerance", [None, 6, 0.5])
def test_nearest_time_matches_brute_force(spark, tolerance):
    rng = np.random.default_rng(7)
    base = dt.datetime(2019, 12, 30)
    left = [(i, base + dt.timedelta(seconds=int(s) * 0.5)) for i, s in enumerate(rng.integers(0, 2 * 86400 * 9, 150))]
    right = [(i, base + dt.timedelta(seconds=int(s) * 0.5)) for i, s in enumerate(rng.integers(2 * 86400, 2 * 86400 * 6, 40))]
    right += [(100, right[3][1]), (101, base + dt.timedelta(days=3)), (102, base + dt.timedelta(days=3, hours=2))]
    left += [(900, base + dt.timedelta(days=3, hours=1)), (901, right[3][1])]  # a tie; an exact hit on a repeated time
    a = spark.createDataFrame([("k", *r) for r in left], "g string, lid int, t timestamp_ntz")
    b = spark.createDataFrame([("k", *r) for r in right] + [("other", 5, base)], "g string, rid int, rt timestamp_ntz")
    got = {r.lid: (r.match_id, r.match_gap_s) for r in pairing.nearest_time(a, b, ["g"], "t", "rt", "rid", tolerance).collect()}
    assert got == nearest(left, right, tolerance)
    alone = a.withColumn("g", F.lit("none"))
    assert pairing.nearest_time(alone, b, ["g"], "t", "rt", "rid", tolerance).isEmpty()


def test_nearest_time_survives_copies(spark):
    """A third of the rows share one moment; still one row per left row and no pair explosion."""
    a = spark.range(3000).select(F.col("id").alias("lid"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("s"))
    a = a.withColumn("t", times.shift_hours(F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), F.col("s").cast("int")))
    out = pairing.nearest_time(a, a.select(F.col("lid").alias("rid"), F.col("t").alias("rt")), [], "t", "rt", "rid")
    assert out.count() == 3000 and out.where("s = 0 and match_id != 0").isEmpty() and out.agg(F.max("match_gap_s")).first()[0] == 0
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_spacing(spark):
    even, gap = cells(spark, 12, sources=("ref",)), cells(spark, 12, sources=("m1",), skip=(5,))
    rows = {r.source: r for r in pairing.delta_steps(even.unionByName(gap), 24, ["source"], strict=False).collect()}
    assert rows["ref"].delta_steps == 4 and rows["ref"].uniform and not rows["m1"].uniform and rows["m1"].delta_steps is None
    for df, hours in ((gap, 24), (even, 7), (cells(spark, 1), 24)):
        with pytest.raises(PySparkException):
            pairing.delta_steps(df, hours, ["source"]).collect()
    assert pairing.delta_steps(even, 24, ["source"]).first().delta_steps == 4


def test_cross_source(spark):
    df = cells(spark, 12)
    pairs = pairing.pair_cross_source(df.where("source = 'm1' and lead_hours = 24"), df.where("source = 'ref' and lead_hours = 0"), 12)
    rows = pairs.where("variable = 'a' and y = 0 and x = 0").collect()
    assert len(rows) == 10 and all(r.prior_time == r.init_time + dt.timedelta(hours=12) and r.prior_value == r.value - 22 for r in rows)


def test_normalize_round_trip_and_gaps(spark):
    df = cells(spark, 6)
    s = stats.field_stats(df)
    back = stats.denormalize(stats.normalize(df, s), s)
    assert back.withColumnRenamed("value", "b").join(df, ["source", "init_time", "lead_hours", "variable", "y", "x"]).where("abs(b - value) > 1e-9").isEmpty()
    holes = df.withColumn("value", F.when(F.col("x") == 0, F.lit(float("nan"))).when(F.col("y") == 0, None).otherwise(F.col("value")))
    z = stats.normalize(holes, stats.field_stats(holes))
    assert z.where("(x = 0 or y = 0) and value != 0").isEmpty()
    assert "BroadcastHashJoin" in z._jdf.queryExecution().toString()
    got = stats.train_stats(df, ["2020-01-01", "2020-01-01"], ["a", "zz"]).collect()
    assert {(r.variable, r["std"]) for r in got if r.variable == "zz"} == {("zz", 1.0)}


def test_prior_of_arrays_and_uneven_keys(spark):
    """Fields paired as arrays; a time that one key lacks stays a place on the axis."""
    t0 = dt.datetime(2020, 1, 1)
    rows = [("a", 0, v, t0 + dt.timedelta(hours=6 * k), [float(k), None if k == 3 else 2.0 * k]) for k in range(6) for v in "tu" if (k, v) != (2, "u")]
    df = spark.createDataFrame(rows, "source string, lead_hours int, variable string, init_time timestamp_ntz, values array<double>")
    pairs = pairing.prior_by_index(df, 2, keys=("variable",), value="values")
    got = {(r.variable, r.init_time): r["values"] for r in pairing.diff_fields(pairs).collect()}
    assert set(got) == {(v, t0 + dt.timedelta(hours=6 * k)) for k in range(2, 6) for v in "tu"} - {("u", t0 + dt.timedelta(hours=h)) for h in (12, 24)}
    assert got["t", t0 + dt.timedelta(hours=12)] == [2.0, 4.0] and got["t", t0 + dt.timedelta(hours=18)] == [2.0, None]


def test_snapshot_stats_equal_cell_stats(spark):
    rng = np.random.default_rng(4)
    rows = [(s, v, 2, 5, [None if x < -1 else float("nan") if x < -0.8 else 1e6 + x for x in rng.normal(size=10).tolist()]) for s in range(40) for v in "tu"]
    df = spark.createDataFrame([*rows, (99, "t", 2, 5, [None] * 10), (99, "empty", 2, 5, [None] * 10)], "sample_id long, variable string, h int, w int, values array<double>")
    got = {r.variable: r for r in stats.snapshot_stats(df).collect()}
    want = {r.variable: r for r in stats.field_stats(compose.to_cells(df)).collect()}
    for v in "tu":
        assert got[v].n == want[v].n and abs(got[v]["mean"] - want[v]["mean"]) < 1e-8 and abs(got[v]["std"] - want[v]["std"]) < 1e-9
    assert got["empty"].n == 0 and got["empty"]["std"] == 1.0
