"""Scans, extracts and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlab.functions import times
from fieldlab.operators import catalog, compose, select, stats
from fieldlab.plans.registry import query
from fieldlab.plans.views import TEST, Views, digest_sql, in_range_sql, ranges_sql
from fieldlab.sources import archive, tables

CELL = "source:s init_time:t lead_hours:i variable:s y:i x:i value:d"


@query(CELL, "SELECT * FROM v_grid WHERE variable IN ('qty', 'tax') AND init_time >= '1996-01-01' AND init_time < '1998-01-01'")
def scan_time_slice(v: Views):
    return archive.time_slice(v.grid, ["qty", "tax"], ["1996-01-01", "1997-12-31"])


@query(CELL, "SELECT g.* FROM v_grid g JOIN v_axis USING (source, init_time) WHERE t_idx = 5")
def scan_snapshot(v: Views):
    return archive.index_slice(v.grid, 5, 6)


@query(
    CELL,
    """SELECT g.* FROM v_grid g JOIN v_axis USING (source, init_time)
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 97 = t_idx)""",
)
def scan_index_list(v: Views):
    wanted = v.table("orders").where(F.col("o_orderstatus") == "P").select((F.col("o_orderkey") % 97).alias("t_idx")).distinct()
    sources = v.grid.select("source").distinct().select("source", F.explode(F.sequence(F.lit(0), F.lit(96))).alias("t_idx"))
    return archive.at_indices(v.grid, sources.join(wanted, "t_idx", "left_semi"))


_UNITS = {
    "view": "hours since 2020-01-01",
    "click": "Days since 1999-12-31 12:00:00",
    "error": "minutes since 1990-06-01 00:00:00",
    "purchase": "seconds since 1970-01-01",
}


@query(
    "event_id:i decoded:t",
    """SELECT event_id, CASE event_type
         WHEN 'view' THEN TIMESTAMP '2020-01-01' + to_microseconds(CAST(round((event_id + value) * 3600 * 1000000) AS BIGINT))
         WHEN 'click' THEN TIMESTAMP '1999-12-31' + to_microseconds(CAST(round((event_id + value) * 86400 * 1000000) AS BIGINT))
         WHEN 'error' THEN TIMESTAMP '1990-06-01' + to_microseconds(CAST(round((event_id + value) * 60 * 1000000) AS BIGINT))
         WHEN 'purchase' THEN TIMESTAMP '1970-01-01' + to_microseconds(CAST(round((event_id + value) * 1000000) AS BIGINT))
         ELSE TIMESTAMP '2000-01-01' + to_microseconds(CAST(round((event_id + value) * 86400 * 1000000) AS BIGINT)) END AS decoded
       FROM events""",
)
def decode_cf_time(v: Views):
    units = F.lit("days since 2000-01-01")
    for kind, text in _UNITS.items():
        units = F.when(F.col("event_type") == kind, text).otherwise(units)
    return v.table("events").select("event_id", times.decode_cf(F.col("event_id") + F.col("value"), units).alias("decoded"))


@query(
    "source:s valid_time:t variable:s y:i x:i value:d",
    "SELECT *, init_time + INTERVAL 24 HOUR AS valid_time FROM v_grid WHERE lead_hours = 24",
)
def scan_forecast_lead(v: Views):
    return archive.forecast_at_lead(v.grid, 24)


@query(CELL, """SELECT * FROM v_grid WHERE variable IN ('qty', 'price') AND init_time BETWEEN '1994-01-01' AND '1996-12-31'
       AND lead_hours IN (6, 12, 24)""")
def extract_archive(v: Views):
    return archive.extract_archive(v.grid, ["qty", "price"], ["1994-01-01", "1996-12-31"], [6, 12, 24, 36])[0]


@query(
    "source:s valid_time:t variable:s y:i x:i value:d",
    """SELECT *, init_time + INTERVAL 48 HOUR AS valid_time FROM v_grid WHERE lead_hours = 48 AND variable IN ('qty', 'tax')
       AND init_time + INTERVAL 48 HOUR BETWEEN '1995-01-02' AND '1997-12-31'""",
)
def extract_forecast(v: Views):
    return archive.extract_forecast(v.grid, ["qty", "tax", "absent"], ["1995-01-02", "1997-12-31"], 48)


@query(
    "source:s variable:s n:i mean:d",
    """SELECT CASE source WHEN 'A' THEN 'model_a' ELSE 'model_r' END AS source, variable, count(*) AS n, avg(value) AS mean FROM v_grid
       WHERE source IN ('A', 'R') AND init_time >= '1996-01-01' GROUP BY 1, 2""",
)
def union_sources(v: Views):
    recent = archive.time_slice(v.grid, None, ["1996-01-01", None])
    pool = archive.union_sources({f"model_{s.lower()}": recent.where(F.col("source") == s) for s in ("A", "R")})
    return pool.groupBy("source", "variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query(
    "path:s",
    """SELECT path FROM v_files UNION SELECT '/data/part_' || p_size || '_6steps_2020-01-01_2020-12-31.nc' FROM part
       UNION SELECT DISTINCT path FROM v_files WHERE path LIKE '%pangu%'""",
)
def candidate_files(v: Views):
    extra = F.concat(F.lit("/data/part_"), F.col("p_size"), F.lit("_6steps_2020-01-01_2020-12-31.nc"))
    return catalog.candidate_files(v.files, v.table("part").select(extra.alias("path")), v.files.where(F.col("path").contains("pangu")))


@query(
    "variable:s n:i min_value:d max_value:d first_time:t last_time:t min_lat:d max_lat:d min_lon:d max_lon:d",
    """SELECT variable, count(value) AS n, min(value) AS min_value, max(value) AS max_value, min(init_time) AS first_time,
       max(init_time) AS last_time, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon
       FROM v_grid GROUP BY variable""",
)
def profile_variables(v: Views):
    return archive.profile_variables(v.grid)


@query("source:s lead_hours:i", "SELECT DISTINCT source, lead_hours FROM v_grid")
def profile_leads(v: Views):
    return archive.profile_leads(v.grid)


@query(
    "series:s x:d value:d stderr:d",
    """SELECT model AS series, lead_hours AS x, avg(logit) AS value,
         CASE WHEN model IN ('m1', 'm2') THEN 0.0 ELSE coalesce(stddev_samp(logit) / sqrt(count(*)), 0) END AS stderr
       FROM v_logit WHERE critic = 'c0' AND label = 1 GROUP BY 1, 2""",
)
def cache_lookup(v: Views):
    from fieldlab.operators.scores import expectation

    first = v.logit.where(F.col("critic") == "c0")
    curve = expectation(first, ["model", "lead_hours", "label"]).select(
        F.lit("logit").alias("metric"), F.col("model").alias("series"), F.col("lead_hours").cast("double").alias("x"),
        F.col("mean").alias("value"),
        F.when(~F.col("model").isin("m1", "m2"), F.col("stderr")).alias("stderr"),
        F.when(F.col("label") == 1, F.create_map(F.lit("kind"), F.lit("logit"), F.lit("real_file"), F.lit("a")))
        .otherwise(F.create_map(F.lit("kind"), F.lit("logit"))).alias("provenance"),
    )
    return tables.matching_curve(curve, {"kind": "logit", "real_file": "a"})


# --- selection ----------------------------------------------------------------------------------------------------------------


@query("variable:s n:i mean:d", "SELECT variable, count(*) AS n, avg(value) AS mean FROM v_grid WHERE variable IN ('disc', 'tax') GROUP BY 1")
def select_variables(v: Views):
    return select.select_variables(v.grid, ["disc", "tax"]).groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query(
    "source:s variable:s",
    """SELECT s.source, w.variable FROM (SELECT DISTINCT source FROM v_levels) s,
       (SELECT unnest(['qty', 'wind', 'tax_500']) AS variable) w
       WHERE NOT EXISTS (SELECT 1 FROM v_levels g WHERE g.source = s.source
         AND (CASE WHEN g.level IS NULL THEN g.variable ELSE g.variable || '_' || g.level END) = w.variable)""",
)
def missing_variables(v: Views):
    named = v.levels.withColumn("variable", F.concat_ws("_", "variable", F.col("level").cast("string")))
    return select.missing_variables(named, ["qty", "wind", "tax_500"])


@query(
    "source:s variable:s",
    """SELECT DISTINCT source, variable || '_' || level AS variable FROM v_levels WHERE level IS NOT NULL AND variable IN ('qty', 'tax')
       AND level = 500""",
)
def available_variables(v: Views):
    named = v.levels.withColumn("variable", F.concat_ws("_", "variable", F.col("level").cast("string")))
    return select.available_variables(named, ["qty_500", "tax_500", "wind_500"])


@query("source:s variable:s n:i mean:d", """SELECT source, variable, count(*) AS n, avg(value) AS mean FROM v_levels
       WHERE level = 850 OR level IS NULL GROUP BY 1, 2""")
def select_level(v: Views):
    return select.select_level(v.levels, 850).groupBy("source", "variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


_OVERLAPPING = [["1994-01-01", "1996-12-31"], ["1996-07-01", "1997-03-31"], ["2001-04-01", None]]


@query(CELL, f"SELECT g.* FROM v_grid g, {ranges_sql(_OVERLAPPING)} WHERE {in_range_sql()}")
def select_time_ranges(v: Views):
    return select.select_time_ranges(v.grid, _OVERLAPPING)


@query(
    "source:s n_times:i",
    f"""SELECT source, count(*) AS n_times FROM v_axis WHERE
        EXISTS (SELECT 1 FROM {ranges_sql(_OVERLAPPING)} WHERE {in_range_sql()})
        AND EXISTS (SELECT 1 FROM {ranges_sql(TEST)} WHERE {in_range_sql()}) GROUP BY source""",
)
def range_overlaps(v: Views):
    """Times that lie both in train and test ranges: the leak that the overlap check forbids."""
    t = F.col("init_time")
    leaked = v.grid.where(select.in_ranges(_OVERLAPPING, t) & select.in_ranges(TEST, t))
    return leaked.select("source", "init_time").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_times"))


@query(
    "event_id:i lead_hours:i",
    """SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0) AS BIGINT) AS lead_hours FROM events""",
)
def lead_hours(v: Views):
    lead = F.col("ts") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return v.table("events").select("event_id", times.lead_to_hours(lead).alias("lead_hours"))


@query("source:s lead_hours:i n:i", "SELECT source, lead_hours, count(*) AS n FROM v_grid WHERE lead_hours > 0 GROUP BY 1, 2")
def filter_leads(v: Views):
    return select.filter_leads(v.grid, None).groupBy("source", "lead_hours").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source:s lead_hours:i",
    """SELECT m.source, unnest([6, 12, 36, 48, 240]) AS lead_hours FROM (SELECT DISTINCT model AS source FROM v_vec) m
       EXCEPT SELECT model, lead_hours FROM v_vec""",
)
def missing_leads(v: Views):
    return select.missing_leads(v.vec.withColumn("source", F.col("model")), [6, 12, 36, 48, 240])


@query(
    CELL,
    """SELECT g.* FROM (SELECT * FROM v_grid WHERE source <> 'R' OR lead_hours > 0) g
       WHERE lead_hours = (CASE WHEN g.source = 'R' THEN 6 ELSE 0 END)""",
)
def zero_lead(v: Views):
    return select.zero_lead(v.grid.where((F.col("source") != "R") | (F.col("lead_hours") > 0)))


@query("source:s valid_time:t n:i", "SELECT source, init_time + to_hours(lead_hours) AS valid_time, count(*) AS n FROM v_grid GROUP BY 1, 2")
def valid_time(v: Views):
    valid = times.valid_time(F.col("init_time"), F.col("lead_hours"))
    return v.grid.groupBy("source", valid.alias("valid_time")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "source:s n:i first_time:t last_time:t",
    """WITH g AS (SELECT *, init_time >= '1999-01-01' AS inside FROM v_grid WHERE source <> 'R' OR init_time < '1999-01-01')
       SELECT source, count(*) AS n, min(init_time) AS first_time, max(init_time) AS last_time FROM g
       WHERE inside OR source NOT IN (SELECT source FROM g WHERE inside) GROUP BY source""",
)
def range_fallback(v: Views):
    cells = v.grid.where((F.col("source") != "R") | (F.col("init_time") < F.lit("1999-01-01").cast("timestamp_ntz")))
    kept = select.range_fallback(cells, ["1999-01-01", None])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("init_time").alias("first_time"), F.max("init_time").alias("last_time"))


@query(
    "source:s init_time:t n:i",
    """WITH p AS (SELECT DISTINCT source, CASE WHEN i = 9 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 9.0)) AS BIGINT) END AS t_idx
                  FROM v_axis, range(10) AS k(i))
       SELECT source, init_time, count(*) AS n FROM v_grid JOIN v_axis USING (source, init_time) JOIN p USING (source, t_idx) GROUP BY 1, 2""",
)
def even_subsample(v: Views):
    return select.even_subsample(v.grid, 10).groupBy("source", "init_time").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source:s split:s n:i first_time:t last_time:t",
    """SELECT source, CASE WHEN t_idx < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split, count(*) AS n, min(init_time) AS first_time,
       max(init_time) AS last_time FROM v_axis GROUP BY 1, 2""",
)
def time_split(v: Views):
    rows = select.time_split(v.grid.select("source", "init_time").distinct(), 0.8)
    return rows.groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("init_time").alias("first_time"), F.max("init_time").alias("last_time")
    )


@query(
    "source:s split:s n:i first_time:t",
    """WITH a AS (SELECT *, floor(n * 0.8) AS cut FROM v_axis)
       SELECT source, CASE WHEN t_idx < cut THEN 'train' ELSE 'val' END AS split, count(*) AS n, min(init_time) AS first_time FROM a
       WHERE CASE WHEN t_idx < cut THEN t_idx ELSE t_idx - cut END >= 2 GROUP BY 1, 2""",
)
def split_shift(v: Views):
    rows = select.time_split(v.grid.select("source", "init_time").distinct(), 0.8, delta=2)
    return rows.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"), F.min("init_time").alias("first_time"))


@query(
    "event_id:i",
    """WITH f AS (SELECT ts FROM events WHERE event_type = 'click' AND hour(ts) % 3 = 0)
       SELECT event_id FROM events WHERE event_type = 'view' AND hour(ts) IN (SELECT hour(ts) FROM f)
       AND ts BETWEEN (SELECT min(ts) FROM f) AND (SELECT max(ts) FROM f)""",
)
def ref_pool(v: Views):
    e = v.table("events")
    forecast = e.where((F.col("event_type") == "click") & (F.hour("ts") % 3 == 0))
    return select.reference_pool(e.where(F.col("event_type") == "view"), forecast, time="ts")


@query(
    "n:i zeros:i total:d finite:i",
    """SELECT count(*) AS n, sum(CASE WHEN l_partkey % 7 = 0 OR l_discount = 0 THEN 1 ELSE 0 END) AS zeros,
       sum(CASE WHEN l_partkey % 7 = 0 THEN 0.0 ELSE l_discount END) AS total,
       sum(CASE WHEN l_partkey % 7 = 0 OR l_partkey % 11 = 0 THEN 0 ELSE 1 END) AS finite FROM lineitem""",
)
def nan_to_zero(v: Views):
    part = F.col("l_partkey")
    raw = F.when(part % 7 == 0, F.when(part % 2 == 0, F.lit(float("nan")))).otherwise(F.col("l_discount"))
    wild = F.when((part % 11 == 0) & (part % 7 != 0), F.lit(float("inf"))).otherwise(raw)
    clean = stats.nan_to_zero(raw)
    return v.table("lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.sum((clean == 0).cast("int")).alias("zeros"), F.sum(clean).alias("total"),
        F.sum(stats.is_finite(wild).cast("int")).alias("finite"),
    )


_SNAP_SQL = "SELECT sample_id, source, y, x, max(value) FILTER (variable = 'u') AS u, max(value) FILTER (variable = 'v') AS v, max(value) FILTER (variable = 't') AS t, max(value) FILTER (variable = 'p') AS p FROM v_cell4 GROUP BY 1, 2, 3, 4"


@query("sample_id:i y:i x:i speed:d", f"SELECT sample_id, y, x, sqrt(u * u + v * v) AS speed FROM ({_SNAP_SQL})")
def wind_speed(v: Views):
    wide = compose.pivot_channels(compose.to_cells(v.snap4).select("sample_id", "y", "x", "variable", "value"), ["u", "v"])
    return wide.select("sample_id", "y", "x", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2).alias("speed"))


@query("sample_id:i y:i x:i celsius:d hpa:d", f"SELECT sample_id, y, x, t - 273.15 AS celsius, p / 100 AS hpa FROM ({_SNAP_SQL})")
def unit_convert(v: Views):
    wide = compose.pivot_channels(compose.to_cells(v.snap4).select("sample_id", "y", "x", "variable", "value"), ["t", "p"])
    return wide.select("sample_id", "y", "x", (F.col("t") - 273.15).alias("celsius"), (F.col("p") / 100).alias("hpa"))


@query(
    "source:s init_time:t lead_hours:i variable:s y:i lon180:d place:i value:d",
    """SELECT *, row_number() OVER (PARTITION BY source, init_time, lead_hours, variable, y ORDER BY lon180) AS place
       FROM (SELECT *, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon180 FROM v_grid)""",
)
def lon_shift(v: Views):
    """Longitudes re-centred and renumbered; a window holds one grid row of one field."""
    from pyspark.sql import Window as W

    row = W.partitionBy("source", "init_time", "lead_hours", "variable", "y").orderBy("lon180")
    shifted = v.grid.withColumn("lon180", compose.shift_longitude(F.col("lon")))
    return shifted.withColumn("place", F.row_number().over(row))


@query("sample_id:i y:i x:i value:d", "SELECT sample_id, y, 7 - x AS x, value FROM v_cell8")
def flip_lon(v: Views):
    flipped = v.snap8.withColumn("values", compose.flip_lon_field(F.col("values"), F.col("w")))
    return compose.to_cells(flipped)


@query("sample_id:i pos:i value:d", "SELECT sample_id, (pos % 16) * 4 + pos // 16 AS pos, value FROM v_cell8")
def transpose_grid(v: Views):
    """The 64 values read as a 4 x 16 field and transposed to 16 x 4."""
    field = v.snap8.withColumn("values", compose.transpose_field(F.col("values"), F.lit(4), F.lit(16)))
    return field.select("sample_id", F.posexplode("values").alias("pos", "value"))


@query("event_id:i ts:t value:d", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 100")
def first_n(v: Views):
    return select.first_n(v.table("events"), ["ts", "event_id"], 100)


@query("sample_id:i", f"SELECT sample_id FROM v_vec ORDER BY {digest_sql(7, repr('cap'), 'sample_id')}, sample_id LIMIT 200")
def cap_random(v: Views):
    return select.cap_random(v.vec, "sample_id", 200, seed=7)


@query(
    "sample_id:i half:s",
    f"""WITH r AS (SELECT event_id AS sample_id, row_number() OVER (ORDER BY {digest_sql(3, repr('half'), 'event_id')}, event_id) - 1 AS p,
        count(*) OVER () // 2 AS h FROM events)
        SELECT sample_id, CASE WHEN p < h THEN 'a' ELSE 'b' END AS half FROM r WHERE p < 2 * h""",
)
def split_halves(v: Views):
    return select.split_halves(v.table("events").select(F.col("event_id").alias("sample_id")), "sample_id", seed=3)


@query(
    "sample_id:i split:s",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {digest_sql(3, repr('split'), 'sample_id')}, sample_id) - 1 AS p,
        count(*) OVER () AS n FROM v_vec)
        SELECT sample_id, CASE WHEN p < greatest(1, floor(n * 0.8)) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def probe_split(v: Views):
    return select.random_split(v.vec.select("sample_id"), "sample_id", 0.8, seed=3)


