"""Corruptions, disturbances, random policies and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlab.functions.keyed import uniform
from fieldlab.operators import compose, corrupt, select, spectra, stats
from fieldlab.plans.composition import padded_fields, padded_sql
from fieldlab.plans.registry import query
from fieldlab.plans.views import CHANNELS, Views, digest_sql, normal_sql, uniform_sql

CELL8 = "sample_id:i y:i x:i value:d"
CELL4 = "sample_id:i variable:s y:i x:i value:d"


def _blur_sql(cells: str, sigma: float, n: int = 8) -> str:
    """Separable blur of n x n fields (sample_id, y, x, value) as two joins with the tap table."""
    radius = int(4 * sigma + 0.5)
    taps = f"""(SELECT i, s, sum(g) AS g FROM (
      SELECT i, CASE WHEN m < {n} THEN m ELSE {2 * n - 1} - m END AS s, exp(-k * k / {2 * sigma * sigma}) / (SELECT sum(exp(-q * q / {2 * sigma * sigma}))
        FROM range({-radius}, {radius + 1}) AS t(q)) AS g
      FROM (SELECT i, k, ((i + k) % {2 * n} + {2 * n}) % {2 * n} AS m FROM range({n}) AS a(i), range({-radius}, {radius + 1}) AS b(k))) GROUP BY i, s)"""
    return f"""SELECT sample_id, a.i AS y, b.i AS x, CASE WHEN count(value) = count(*) THEN sum(a.g * b.g * value) END AS value
      FROM ({cells}) c JOIN {taps} a ON a.s = c.y JOIN {taps} b ON b.s = c.x GROUP BY 1, 2, 3"""


_NOISE8 = normal_sql(0, "'{0}'", "sample_id", "variable", "pos")
_STD8 = "stddev_pop(value) OVER (PARTITION BY variable)"
_FIELD8 = "SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, min(value) OVER w AS lo, max(value) OVER w AS hi FROM v_cell8 WINDOW w AS (PARTITION BY sample_id)"


@query(CELL8, _blur_sql("SELECT * FROM v_cell8", 1.125))
def corrupt_blur(v: Views):
    return compose.to_cells(corrupt.blur(v.snap8, 1.0))


_GAPS_SQL = f"SELECT * REPLACE (CASE WHEN {uniform_sql(3, repr('gap'), 'sample_id', 'pos')} >= 0.02 THEN value END AS value) FROM v_cell8"


def _with_gaps(v: Views):
    """Fields that lack about one cell in fifty."""
    return v.snap8.withColumn("values", F.transform("values", lambda c, i: F.when(uniform(3, "gap", F.col("sample_id"), i) >= 0.02, c)))


@query(CELL8, _blur_sql(_GAPS_SQL, 0.5 * 1.125))
def corrupt_blur_gaps(v: Views):
    """A missing cell reaches as far as the taps, not over the whole field."""
    return compose.to_cells(corrupt.blur(_with_gaps(v), 0.5))


@query(CELL8, _blur_sql(_GAPS_SQL, 0.5))
def disturb_blur_gaps(v: Views):
    return compose.to_cells(corrupt.disturb(_with_gaps(v), "blur", 0.5))


@query(
    "corruption:s sample_id:i y:i x:i value:d",
    f"""SELECT 'blur' AS corruption, * FROM ({padded_sql(_blur_sql("SELECT * FROM v_cell8", 0.5 * 1.125))})
        UNION ALL SELECT 'noise', * FROM ({padded_sql(f"SELECT sample_id, y, x, value + 0.5 * 0.25 * {_NOISE8.format('noise')} AS value FROM v_cell8")})""",
)
def corrupt_padded(v: Views):
    """Padded fields: the interior is corrupted, the padding is made anew from it."""
    fields = padded_fields(v)
    blurred, noisy = (compose.to_cells(corrupt.corrupt(fields, name, 0.5, padded=(15, 24))).withColumn("corruption", F.lit(name)) for name in ("blur", "noise"))
    return blurred.unionByName(noisy)


@query(CELL4, f"SELECT sample_id, variable, y, x, value + 0.5 * 0.25 * {_NOISE8.format('noise')} AS value FROM v_cell4")
def corrupt_noise(v: Views):
    return compose.to_cells(corrupt.noise(v.snap4, 0.5))


@query(CELL8)
def corrupt_grf(v: Views):
    return compose.to_cells(corrupt.grf(v.snap8, 1.0))


@query(
    CELL4,
    f"""SELECT sample_id, variable, y, x, CASE WHEN {uniform_sql(0, "'replace'", "sample_id", "variable", "pos")} < 0.3
        THEN {_NOISE8.format('fresh')} ELSE value END AS value FROM v_cell4""",
)
def corrupt_pixel_replace(v: Views):
    return compose.to_cells(corrupt.pixel_replace(v.snap4, 1.0))


@query(
    CELL4,
    f"""WITH p AS (SELECT sample_id, unnest(range(4)) AS p FROM v_vec),
        k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {digest_sql(0, "'pick'", "sample_id", "p")}) AS i FROM p)
              WHERE i <= 3),
        s AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {digest_sql(0, "'order'", "sample_id", "p")}) AS j FROM k),
        m AS (SELECT a.sample_id, a.p AS dst, b.p AS src FROM s a JOIN s b ON a.sample_id = b.sample_id AND a.i = b.j),
        c AS (SELECT *, (y // 2) * 2 + x // 2 AS patch FROM v_cell4)
        SELECT c.sample_id, c.variable, c.y, c.x, CASE WHEN m.src IS NOT NULL AND c.variable IN ('u', 'v') THEN f.value ELSE c.value END AS value
        FROM c LEFT JOIN m ON m.sample_id = c.sample_id AND m.dst = c.patch
        LEFT JOIN v_cell4 f ON f.sample_id = c.sample_id AND f.variable = c.variable
          AND f.y = (m.src // 2) * 2 + c.y % 2 AND f.x = (m.src % 2) * 2 + c.x % 2""",
)
def corrupt_patch_shuffle(v: Views):
    return compose.to_cells(corrupt.wind_patch_shuffle(v.snap4, 0.7, patch=2))


def _rotated_sql(source: str, angle: str) -> str:
    return f"""SELECT a.*  REPLACE (CASE WHEN a.variable = 'u' THEN cos({angle}) * a.value - sin({angle}) * b.value
        WHEN a.variable = 'v' THEN sin({angle}) * b.value + cos({angle}) * a.value ELSE a.value END AS value) FROM {source} a
      LEFT JOIN {source} b ON a.sample_id = b.sample_id AND a.y = b.y AND a.x = b.x
        AND ((a.variable = 'u' AND b.variable = 'v') OR (a.variable = 'v' AND b.variable = 'u'))"""


@query(CELL4, f"SELECT sample_id, variable, y, x, value FROM ({_rotated_sql('v_cell4', '0.5 * pi() / 2')})")
def corrupt_rotation(v: Views):
    return compose.to_cells(corrupt.wind_rotation(v.snap4, 0.5))


@query(
    "severity:d variable:s mean:d spread:d",
    f"""SELECT l.i / 4.0 AS severity, variable, avg(CASE WHEN variable = 'u' THEN cos(l.i * pi() / 8) * value - sin(l.i * pi() / 8) * other
          WHEN variable = 'v' THEN sin(l.i * pi() / 8) * other + cos(l.i * pi() / 8) * value ELSE value END) AS mean,
        stddev_pop(CASE WHEN variable = 'u' THEN cos(l.i * pi() / 8) * value - sin(l.i * pi() / 8) * other
          WHEN variable = 'v' THEN sin(l.i * pi() / 8) * other + cos(l.i * pi() / 8) * value ELSE value END) AS spread
        FROM (SELECT a.*, b.value AS other FROM v_cell4 a LEFT JOIN v_cell4 b ON a.sample_id = b.sample_id AND a.y = b.y AND a.x = b.x
          AND ((a.variable = 'u' AND b.variable = 'v') OR (a.variable = 'v' AND b.variable = 'u'))), range(9) AS l(i) GROUP BY 1, 2""",
)
def severity_ladder(v: Views):
    """Every sample rotated at every step of the ladder, in one job."""
    sweep = corrupt.ladder_sweep(v.snap4, ["wind_rotation"])
    turned = corrupt.wind_rotation(sweep, F.col("severity"), by=("sample_id", "severity"))
    cells = compose.to_cells(turned)
    return cells.groupBy("severity", "variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))


@query(
    "sample_id:i corruption:s severity:d",
    """SELECT sample_id, unnest(['blur', 'noise', 'grf', 'pixel_replace', 'wind_patch_shuffle', 'wind_rotation']) AS corruption, s.i / 4.0 AS severity
       FROM v_vec, range(9) AS s(i)""",
)
def ladder_sweep(v: Views):
    return corrupt.ladder_sweep(v.vec.select("sample_id"))


@query(
    CELL4,
    f"""SELECT sample_id, variable, y, x, CASE WHEN variable = 'p' THEN value + 0.25 * {_NOISE8.format('noise')} ELSE value END AS value
        FROM v_cell4""",
)
def corrupt_fieldwise(v: Views):
    return compose.to_cells(corrupt.corrupt_fieldwise(v.snap4, "hf_noise", "p", 1.0))


_SUBSET_SQL = f"""SELECT sample_id, variable FROM (
    SELECT sample_id, unnest(CASE WHEN len(drawn) > 0 THEN drawn
      ELSE [['t', 'u', 'v', 'p'][CAST(floor({uniform_sql(0, "'lone'", 'sample_id')} * 4) AS INTEGER) + 1]] END) AS variable
    FROM (SELECT sample_id, coalesce(list(c) FILTER ({uniform_sql(0, "'field'", 'sample_id', 'c')} < 0.5), []) AS drawn
          FROM v_vec, (SELECT unnest(['t', 'u', 'v', 'p']) AS c) GROUP BY sample_id))"""


@query("sample_id:i variable:s", _SUBSET_SQL)
def field_subset(v: Views):
    return corrupt.field_subset(v.vec.select("sample_id"), CHANNELS, 0.5)


@query("event_id:i severity:d", f"SELECT event_id, 2 * pow({uniform_sql(5, repr('sev'), 'event_id')}, 3) AS severity FROM events")
def power_severity(v: Views):
    return v.table("events").select("event_id", corrupt.power_severity(uniform(5, "sev", F.col("event_id")), 2.0, 3.0).alias("severity"))


@query(
    "sample_id:i corruption:s variable:s severity:d",
    f"""WITH t AS (SELECT sample_id, ['blur', 'noise', 'grf', 'pixel_replace', 'wind_patch_shuffle', 'wind_rotation']
          [CAST(floor({uniform_sql(0, "'type'", 'sample_id')} * 6) AS INTEGER) + 1] AS corruption FROM v_vec),
        p AS (SELECT t.*, s.variable FROM t JOIN ({_SUBSET_SQL}) s USING (sample_id) WHERE corruption NOT LIKE 'wind%'
              UNION ALL SELECT t.*, NULL FROM t WHERE corruption LIKE 'wind%')
        SELECT *, pow({uniform_sql(0, "'severity'", 'sample_id', "coalesce(variable, 'all')")}, 2) AS severity FROM p""",
)
def corruption_plan(v: Views):
    types = ["gaussian_blur", "hf_noise", "gaussian_field_noise", "pixel_replace", "wind_shuffled", "wind_rotated"]
    return corrupt.corruption_plan(v.vec.select("sample_id"), types, CHANNELS)


@query(CELL4)
def corrupt_planned(v: Views):
    """The random policy carried out: each sample by its own type, fields and severities."""
    types = ["blur", "hf_noise", "grf", "pixel_replace", "wind_rotation", "wind_patch_shuffle"]
    plan = corrupt.corruption_plan(v.vec.select("sample_id"), types, CHANNELS, 2.0)
    return compose.to_cells(corrupt.apply_plan(v.snap4, plan, types, patch=2))


@query(
    CELL4,
    f"""WITH s AS (SELECT variable, avg(value) AS mean, stddev_pop(value) AS std FROM v_cell4 GROUP BY 1),
        z AS (SELECT sample_id, variable, y, x, (value - mean) / std AS value FROM v_cell4 JOIN s USING (variable))
        SELECT r.sample_id, r.variable, r.y, r.x, r.value * std + mean AS value FROM ({_rotated_sql('z', '1.0 * pi() / 2')}) r JOIN s USING (variable)""",
)
def corrupt_raw_roundtrip(v: Views):
    s = stats.snapshot_stats(v.snap4)
    return compose.to_cells(compose.denormalize_snapshots(corrupt.wind_rotation(compose.normalize_snapshots(v.snap4, s), 1.0), s))


# --- analysis disturbances ----------------------------------------------------------------------------------------------------


def _with_std(v: Views):
    std = stats.snapshot_stats(v.snap8).select("variable", "std")
    return v.snap8.join(std, "variable")


@query(CELL8, _blur_sql("SELECT * FROM v_cell8", 1.5))
def disturb_blur(v: Views):
    return compose.to_cells(corrupt.disturb(v.snap8, "gaussian_blur", 1.5))


@query(CELL8, f"SELECT sample_id, y, x, value + 0.3 * {_STD8} * {_NOISE8.format('dnoise')} AS value FROM v_cell8")
def disturb_noise(v: Views):
    return compose.to_cells(corrupt.disturb(_with_std(v), "noise", 0.3))


@query(
    CELL8,
    f"""WITH g AS ({_blur_sql(f"SELECT sample_id, y, x, {_NOISE8.format('dgrf')} AS value FROM v_cell8", 2.0)}),
        z AS (SELECT *, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS zz FROM g WINDOW w AS (PARTITION BY sample_id))
        SELECT c.sample_id, c.y, c.x, c.value + 0.6 * std * zz AS value FROM (SELECT *, {_STD8} AS std FROM v_cell8) c JOIN z
        ON z.sample_id = c.sample_id AND z.y = c.y AND z.x = c.x""",
)
def disturb_grf(v: Views):
    return compose.to_cells(corrupt.disturb(_with_std(v), "grf", 0.6))


@query(
    CELL8,
    f"""SELECT sample_id, y, x, CASE WHEN r <= 19 THEN m + sd * {_NOISE8.format('dfresh')} ELSE value END AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {digest_sql(0, "'dpick'", "sample_id", "variable", "pos")}) AS r FROM ({_FIELD8}))""",
)
def disturb_replace(v: Views):
    return compose.to_cells(corrupt.disturb(v.snap8, "replace", 0.3))


@query(
    CELL8,
    f"""WITH p AS (SELECT sample_id, p, row_number() OVER (PARTITION BY sample_id ORDER BY {digest_sql(0, "'dpatch'", "sample_id", "'f' || sample_id % 2", "p")}) AS r
          FROM (SELECT sample_id, unnest(range(16)) AS p FROM v_vec))
        SELECT c.sample_id, c.y, c.x, CASE WHEN r <= 4 THEN m ELSE value END AS value FROM ({_FIELD8}) c JOIN p
        ON p.sample_id = c.sample_id AND p.p = (c.y // 2) * 4 + c.x // 2""",
)
def disturb_patch(v: Views):
    return compose.to_cells(corrupt.disturb_patch(v.snap8, 0.3, patch=2))


@query(
    CELL8,
    f"""SELECT sample_id, y, x, CASE WHEN hi = lo THEN value ELSE round_even((value - lo) / (hi - lo) * 7, 0) / 7 * (hi - lo) + lo END AS value
        FROM ({_FIELD8})""",
)
def disturb_quantize(v: Views):
    return compose.to_cells(corrupt.disturb(v.snap8, "quantization", 8))


@query(
    "sample_id:s variable:s y:i x:i value:d",
    f"""WITH p AS (SELECT DISTINCT CASE WHEN i = 9 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 9.0)) AS BIGINT) END AS t_idx
                   FROM v_axis, range(10) AS k(i) WHERE source = 'N'),
        t AS (SELECT DISTINCT init_time, 'N-' || strftime(init_time, '%Y-%m-%d') AS sample_id FROM v_axis JOIN p USING (t_idx) WHERE source = 'N'),
        d AS (SELECT sample_id, t.init_time, w.variable, y, x, y * 8 + x AS pos FROM t, (SELECT unnest(['qty', 'price', 'disc', 'tax']) AS variable) w,
              (SELECT unnest(range(4)) AS y) ys, (SELECT unnest(range(8)) AS x) xs)
        SELECT d.sample_id, d.variable, d.y, d.x, coalesce((g.value + 0.3 * std * {_NOISE8.format('dnoise')} - mean) / std, 0) AS value
        FROM d JOIN v_stats USING (variable) LEFT JOIN (SELECT init_time AS t, variable AS gv, y AS gy, x AS gx, value FROM v_grid
          WHERE source = 'N' AND lead_hours = 0) g ON g.t = d.init_time AND gv = d.variable AND gy = d.y AND gx = d.x""",
)
def disturbance_set(v: Views):
    """Reference at lead 0, ten even times, disturbed, normalized, gaps to 0."""
    s = stats.field_stats(v.stored_grid)
    reference = select.even_subsample(select.zero_lead(v.stored_grid.where(F.col("source") == "N")), 10).drop("lat", "lon", "lead_hours")
    named = reference.withColumn("sample_id", F.concat_ws("-", "source", F.col("init_time").cast("date").cast("string")))
    fields = compose.to_snapshots(named, 4, 8).join(s.select("variable", "std"), "variable")
    return compose.to_cells(compose.normalize_snapshots(corrupt.disturb_noise(fields, 0.3).drop("std"), s))


_CATALOG_ROWS = ", ".join(f"('{n}', {float(x)})" for n, levels in corrupt.DISTURBANCE_LEVELS.items() for x in levels)


@query(
    "disturbance:s level:d variable:s amplitude:d",
    f"""SELECT c.disturbance, c.level, variable, CASE WHEN c.disturbance IN ('noise', 'grf') THEN c.level * std ELSE c.level END AS amplitude
        FROM v_stats, (VALUES {_CATALOG_ROWS}) AS c(disturbance, level)""",
)
def disturbance_catalog(v: Views):
    """Every level of every disturbance in the units of each variable."""
    rows = [F.struct(F.lit(n).alias("d"), F.lit(float(x)).alias("l")) for n, levels in corrupt.DISTURBANCE_LEVELS.items() for x in levels]
    out = stats.field_stats(v.grid).select("variable", "std", F.explode(F.array(*rows)).alias("c"))
    amplitude = F.when(F.col("c.d").isin("noise", "grf"), F.col("c.l") * F.col("std")).otherwise(F.col("c.l"))
    return out.select(F.col("c.d").alias("disturbance"), F.col("c.l").alias("level"), "variable", amplitude.alias("amplitude"))


_REQUESTED = ["gaussian_blur", "noise", "high_freq_noise", "pixel_replace", "wind_rotation", "patch_dropout", "quant", "unknown"]


@query(
    "disturbance:s held_out:s",
    f"""SELECT disturbance, CASE WHEN bool_or(p_size > 45 AND p_partkey % 3 = 0) THEN 'true' ELSE 'false' END AS held_out FROM (
          SELECT *, CASE name WHEN 'gaussian_blur' THEN 'blur' WHEN 'high_freq_noise' THEN 'noise' WHEN 'pixel_replace' THEN 'replace'
            WHEN 'patch_dropout' THEN 'patch' ELSE name END AS disturbance FROM (
            SELECT *, {_REQUESTED}[CAST(p_partkey % 8 AS INTEGER) + 1] AS name FROM part))
        WHERE disturbance IN ('blur', 'noise', 'grf', 'replace', 'patch', 'quant') GROUP BY 1""",
)
def disturbance_plan(v: Views):
    names = F.array(*[F.lit(n) for n in _REQUESTED])
    requests = v.table("part").select(
        F.get(names, (F.col("p_partkey") % 8).cast("int")).alias("name"), ((F.col("p_size") > 45) & (F.col("p_partkey") % 3 == 0)).alias("held_out")
    )
    return corrupt.disturbance_plan(requests)


# --- spectra ------------------------------------------------------------------------------------------------------------------

_POWER_SQL = """SELECT sample_id, source, variable, ky, kx, CASE WHEN ky = 0 AND kx = 0 THEN 0 ELSE re * re + im * im END AS power FROM (
  SELECT sample_id, source, variable, ky, kx, sum(d * cos(2 * pi() * (ky * y + kx * x) / 8)) AS re, sum(d * sin(2 * pi() * (ky * y + kx * x) / 8)) AS im
  FROM (SELECT *, value - avg(value) OVER (PARTITION BY sample_id) AS d FROM v_cell8), range(8) AS a(ky), range(8) AS b(kx) GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "source:s variable:s ky:i kx:i log_power:d",
    f"SELECT source, variable, (ky + 4) % 8 AS ky, (kx + 4) % 8 AS kx, avg(log10(power + 1e-8)) AS log_power FROM ({_POWER_SQL}) GROUP BY 1, 2, 3, 4",
)
def psd_2d(v: Views):
    return spectra.psd_2d(v.snap8)


@query(
    "source:s variable:s k:i log_power:d n:i",
    f"""SELECT source, variable, k, avg(lp) AS log_power, count(*) AS n FROM (
          SELECT sample_id, source, variable, CAST(round_even(sqrt(least(ky, 8 - ky) ** 2 + least(kx, 8 - kx) ** 2), 0) AS INTEGER) AS k, log10(avg(power) + 1e-10) AS lp
          FROM ({_POWER_SQL}) GROUP BY 1, 2, 3, 4) WHERE k < 4 GROUP BY 1, 2, 3""",
)
def psd_radial(v: Views):
    return spectra.psd_radial(v.snap8)


@query(
    "source:s variable:s bin:i n:i left:d density:d",
    f"""WITH m AS (SELECT source, variable, log10(power) / 2 AS m FROM ({_POWER_SQL}) WHERE power > 0),
        e AS (SELECT variable, min(m) AS lo, max(m) AS hi FROM m GROUP BY 1),
        b AS (SELECT source, variable, lo, hi, least(floor((m - lo) / ((hi - lo) / 99)), 98) AS bin, count(*) AS n FROM m JOIN e USING (variable)
              GROUP BY 1, 2, 3, 4, 5)
        SELECT source, variable, bin, n, pow(10, lo + bin * (hi - lo) / 99) AS "left", n / (sum(n) OVER (PARTITION BY source, variable)
          * (pow(10, lo + (bin + 1) * (hi - lo) / 99) - pow(10, lo + bin * (hi - lo) / 99))) AS density FROM b""",
)
def psd_histogram(v: Views):
    return spectra.psd_histogram(v.snap8)
