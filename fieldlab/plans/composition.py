"""Statistics, normalization, channel composition, grid geometry and pairing in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlab.functions.reuse import stored
from fieldlab.functions.times import shift_hours
from fieldlab.operators import compose, pairing, stats
from fieldlab.plans.registry import query
from fieldlab.plans.views import CHANNELS, TRAIN, VARIABLES, Views, in_range_sql, ranges_sql

STATS = "variable:s kind:s mean:d std:d n:i"
_STD = "CASE WHEN stddev_pop({0}) > 1e-8 THEN stddev_pop({0}) ELSE 1.0 END"

# Prior values by index: the value of the same cell two places earlier on the time axis of its source and lead.
_PRIOR = """
  SELECT g.*, p.value AS prior_value, p.init_time AS prior_time FROM
    (SELECT g.*, dense_rank() OVER (PARTITION BY source, lead_hours ORDER BY init_time) AS r FROM v_grid g) g
    JOIN (SELECT g.*, dense_rank() OVER (PARTITION BY source, lead_hours ORDER BY init_time) AS r FROM v_grid g) p
    ON p.source = g.source AND p.lead_hours = g.lead_hours AND p.variable = g.variable AND p.y = g.y AND p.x = g.x AND p.r = g.r - 2
"""
_DSTATS = f"""SELECT variable, avg(value - prior_value) AS dmean, {_STD.format('(value - prior_value)')} AS dstd FROM ({_PRIOR}) GROUP BY variable"""
_INDEX = "list_position(['qty', 'price', 'disc', 'tax'], variable) - 1"
_KEYS = "source, init_time, lead_hours, y, x"


@query(STATS, f"SELECT variable, 'abs' AS kind, avg(value) AS mean, {_STD.format('value')} AS std, count(*) AS n FROM v_grid GROUP BY 1")
def stats_abs(v: Views):
    return stats.field_stats(v.grid)


@query(
    STATS,
    f"""SELECT w.variable, 'abs' AS kind, coalesce(avg(value), 0) AS mean, coalesce(max(s.std), 1) AS std, count(value) AS n
        FROM (SELECT unnest(['qty', 'price', 'disc', 'tax', 'wind']) AS variable) w
        LEFT JOIN (SELECT g.variable, g.value FROM v_grid g, {ranges_sql(TRAIN)} WHERE {in_range_sql()}) g USING (variable)
        LEFT JOIN (SELECT g.variable, {_STD.format('value')} AS std FROM v_grid g, {ranges_sql(TRAIN)} WHERE {in_range_sql()} GROUP BY 1) s
        USING (variable) GROUP BY 1""",
)
def stats_train_ranges(v: Views):
    return stats.train_stats(v.grid, TRAIN, [*VARIABLES, "wind"])


@query(
    STATS,
    f"""SELECT variable, 'abs' AS kind, avg(value) AS mean, {_STD.format('value')} AS std, count(*) AS n
        FROM v_grid WHERE (y + x) % 5 > 0 GROUP BY variable""",
)
def stats_finite(v: Views):
    cell = F.col("y") + F.col("x")
    holes = F.when(cell % 10 == 0, F.lit(float("nan"))).when(cell % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return stats.finite_stats(v.grid.withColumn("value", holes))


@query(
    STATS,
    f"""SELECT variable, 'diff' AS kind, avg(value - prior_value) AS mean, {_STD.format('(value - prior_value)')} AS std, count(*) AS n
        FROM ({_PRIOR}) GROUP BY 1""",
)
def stats_diff(v: Views):
    return stats.diff_stats(v.stored_grid, 2)


@query("source:s init_time:t lead_hours:i variable:s y:i x:i value:d", """SELECT g.* REPLACE ((value - mean) / std AS value) FROM v_grid g
       JOIN v_stats USING (variable)""")
def normalize(v: Views):
    return stats.normalize(v.stored_grid, stats.field_stats(v.stored_grid))


_CHANNEL = "source:s init_time:t lead_hours:i y:i x:i channel:i value:d"


def _composed(v: Views, mode: str):
    """Pairs are made once: the difference statistics and the channels read the same stored table."""
    pairs = stored(pairing.prior_by_index(v.stored_grid, 2).drop("prior_time", "lat", "lon"))
    diffs = stats.pair_diff_stats(pairs) if mode in ("diff", "phase") else None
    return compose.compose(pairs, mode, VARIABLES, stats.field_stats(v.stored_grid), diffs)


@query(_CHANNEL, f"SELECT {_KEYS}, {_INDEX} AS channel, (value - mean) / std AS value FROM v_grid JOIN v_stats USING (variable)")
def compose_none(v: Views):
    return compose.compose(v.stored_grid.drop("lat", "lon"), "none", VARIABLES, stats.field_stats(v.stored_grid))


@query(
    _CHANNEL,
    f"""SELECT {_KEYS}, {_INDEX} AS channel, greatest(least((value - prior_value - dmean) / dstd, 15), -15) AS value
        FROM ({_PRIOR}) JOIN ({_DSTATS}) USING (variable)""",
)
def compose_diff(v: Views):
    return _composed(v, "diff")


@query(
    _CHANNEL,
    f"""SELECT {_KEYS}, {_INDEX} + unnest([0, 4]) AS channel, unnest([(prior_value - mean) / std, (value - mean) / std]) AS value
        FROM ({_PRIOR}) JOIN v_stats USING (variable)""",
)
def compose_concat(v: Views):
    return _composed(v, "concat")


@query(
    _CHANNEL,
    f"""SELECT {_KEYS}, {_INDEX} + unnest([0, 4]) AS channel,
          unnest([(value - mean) / std, greatest(least((value - prior_value - dmean) / dstd, 15), -15)]) AS value
        FROM ({_PRIOR}) JOIN v_stats USING (variable) JOIN ({_DSTATS}) USING (variable)""",
)
def compose_phase(v: Views):
    return _composed(v, "phase")


@query("event_id:i clipped:d", "SELECT event_id, greatest(least(value - 20, 15), -15) AS clipped FROM events")
def clip_diff(v: Views):
    return v.table("events").select("event_id", compose.clip_diff(F.col("value") - 20).alias("clipped"))


def padded_sql(cells: str) -> str:
    """8 x 8 fields (sample_id, y, x, value) of all samples, padded to 15 x 24."""
    return f"""SELECT s.sample_id, y, x, coalesce(c.value, 0) AS value FROM (SELECT sample_id FROM v_vec) s,
       (SELECT unnest(range(15)) AS y) ys, (SELECT unnest(range(24)) AS x) xs
       LEFT JOIN (SELECT sample_id AS sid, y AS cy, x AS cx, value FROM ({cells})) c
       ON sid = s.sample_id AND cy = y - 4 AND cx = ((x - 8) % 8 + 8) % 8"""


def padded_fields(v: Views):
    padded = v.snap8.withColumn("values", compose.pad_field(F.col("values"), F.col("h"), F.col("w")))
    return padded.withColumn("h", F.col("h") + 7).withColumn("w", F.col("w") + 16)


@query("sample_id:i y:i x:i value:d", padded_sql("SELECT * FROM v_cell8"))
def pad_grid(v: Views):
    return compose.to_cells(padded_fields(v))


@query("sample_id:i y:i x:i value:d", "SELECT sample_id, y, x, value FROM v_cell8")
def crop_grid(v: Views):
    """Crop undoes pad; a field without the padded size passes through."""
    padded = v.snap8.withColumn("values", compose.pad_field(F.col("values"), F.col("h"), F.col("w")))
    back = compose.crop_if_padded(F.col("values"), F.col("h") + 7, F.col("w") + 16, (15, 24))
    return compose.to_cells(padded.withColumn("values", back))


@query(
    "source:s init_time:t lead_hours:i variable:s y:i x:i value:d",
    """SELECT c.*, w.variable, coalesce(g.value, 0) AS value FROM
       (SELECT DISTINCT source, init_time, lead_hours, y, x FROM v_grid WHERE variable IN ('qty', 'tax')) c,
       (SELECT unnest(['qty', 'tax', 'wind']) AS variable) w
       LEFT JOIN (SELECT source AS s, init_time AS t, lead_hours AS l, y AS gy, x AS gx, variable AS gv, value FROM v_grid) g
       ON s = c.source AND t = c.init_time AND l = c.lead_hours AND gy = c.y AND gx = c.x AND gv = w.variable""",
)
def zero_fill_channels(v: Views):
    return stats.add_missing_channels(v.grid.drop("lat", "lon"), ["qty", "tax", "wind"])


@query(
    "source:s n:i step_s:d uniform:s delta_steps:i",
    """WITH t AS (SELECT source, epoch(init_time) AS s, epoch(init_time) - lag(epoch(init_time)) OVER (PARTITION BY source ORDER BY init_time) AS gap
                  FROM v_series)
       SELECT source, count(*) AS n, avg(gap) AS step_s, CASE WHEN min(gap) = max(gap) THEN 'true' ELSE 'false' END AS uniform,
         CASE WHEN min(gap) = max(gap) AND abs(86400 / avg(gap) - round(86400 / avg(gap))) <= 1e-6 THEN round(86400 / avg(gap)) END AS delta_steps
       FROM t GROUP BY source""",
)
def delta_steps(v: Views):
    return pairing.delta_steps(v.series, 24, ["source"], strict=False)


@query(
    "source:s n:i first_s:i last_s:i uniform:s",
    """WITH d AS (SELECT DISTINCT event_type AS source, CAST(ts AS DATE) AS d FROM events WHERE event_type <> 'click' OR day(ts) <> 5
                  UNION SELECT DISTINCT 'orders', CAST(o_orderdate AS DATE) FROM orders),
       t AS (SELECT source, epoch(d) AS s, epoch(d) - lag(epoch(d)) OVER (PARTITION BY source ORDER BY d) AS gap FROM d)
       SELECT source, count(*) AS n, min(s) AS first_s, max(s) AS last_s,
         CASE WHEN count(DISTINCT gap) <= 1 THEN 'true' ELSE 'false' END AS uniform FROM t GROUP BY source""",
)
def spacing_check(v: Views):
    events = v.table("events").where((F.col("event_type") != "click") | (F.dayofmonth("ts") != 5))
    days = events.select(F.col("event_type").alias("source"), F.col("ts").cast("date").cast("timestamp_ntz").alias("init_time"))
    orders = v.table("orders").select(F.lit("orders").alias("source"), F.col("o_orderdate").cast("date").cast("timestamp_ntz").alias("init_time"))
    return pairing.spacing(days.unionByName(orders), ["source"])


_WIDE_SQL = """SELECT source, init_time, lead_hours, y, x, max(value) FILTER (variable = 'qty') AS qty, max(value) FILTER (variable = 'price') AS price,
  max(value) FILTER (variable = 'disc') AS disc, max(value) FILTER (variable = 'tax') AS tax FROM v_grid GROUP BY 1, 2, 3, 4, 5"""


@query("source:s init_time:t lead_hours:i y:i x:i qty:d price:d disc:d tax:d", _WIDE_SQL)
def pivot_channels(v: Views):
    return compose.pivot_channels(v.grid.drop("lat", "lon"), VARIABLES)


@query(
    "sample_id:i patch:i d:i value:d",
    """SELECT sample_id, (y // 2) * 2 + x // 2 AS patch, (list_position(['t', 'u', 'v', 'p'], variable) - 1) * 4 + (y % 2) * 2 + x % 2 AS d, value
       FROM v_cell4""",
)
def patchify(v: Views):
    return compose.patchify(v.snap4, 2, CHANNELS).select("sample_id", "patch", F.posexplode("token").alias("d", "value"))


# --- pairing ------------------------------------------------------------------------------------------------------------------


@query("source:s init_time:t lead_hours:i variable:s y:i x:i prior_time:t value:d prior_value:d", _PRIOR)
def prior_lag(v: Views):
    return pairing.prior_by_index(v.stored_grid, 2)


@query("source:s init_time:t lead_hours:i variable:s y:i x:i diff:d", f"SELECT *, value - prior_value AS diff FROM ({_PRIOR})")
def diff_snapshots(v: Views):
    """Differences of whole fields, paired and subtracted as arrays."""
    fields = compose.to_snapshots(v.grid.drop("lat", "lon"), 4, 8)
    pairs = pairing.prior_by_index(stored(fields), 2, keys=("variable",), value="values").drop("prior_time")
    return compose.to_cells(pairing.diff_fields(pairs), "diff").where("diff is not null")


@query(
    "source:s init_time:t diff:d",
    """SELECT source, init_time, value - prior AS diff FROM (
         SELECT *, lag(value, 4) OVER (PARTITION BY source ORDER BY init_time) AS prior FROM v_series) WHERE prior IS NOT NULL""",
)
def diff_series(v: Views):
    pairs = pairing.prior_by_index(v.series, 4)
    return pairs.withColumn("diff", F.col("value") - F.col("prior_value"))


_DAYS_SQL = "SELECT event_type AS source, date_trunc('hour', ts) AS t, avg(value) AS value FROM events GROUP BY 1, 2"


def _hours(v: Views):
    ts = F.col("ts")
    hour = ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))
    return v.table("events").groupBy(F.col("event_type").alias("source"), hour.alias("t")).agg(F.avg("value").alias("value"))


@query(
    "source:s t:t prior_time:t value:d prior_value:d",
    f"""SELECT a.source, a.t, b.t AS prior_time, a.value, b.value AS prior_value FROM ({_DAYS_SQL}) a JOIN ({_DAYS_SQL}) b
        ON a.source = b.source AND b.t = a.t - INTERVAL 5 HOUR""",
)
def prior_exact(v: Views):
    return pairing.prior_exact(_hours(v), _hours(v), 5, ["source"], "t", "value")


@query(
    "source:s n:i",
    f"""SELECT a.source, count(*) AS n FROM ({_DAYS_SQL}) a WHERE NOT EXISTS
        (SELECT 1 FROM ({_DAYS_SQL}) b WHERE a.source = b.source AND b.t = a.t - INTERVAL 5 HOUR) GROUP BY 1""",
)
def prior_dropped(v: Views):
    left_out = pairing.prior_dropped(_hours(v), _hours(v), 5, ["source"], "t")
    return left_out.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _clock(v: Views):
    e = v.table("events")
    ref = e.where(F.col("event_type") == "view").select(F.col("event_id").alias("ref_id"), F.col("ts").alias("ref_ts"))
    fc = e.where(F.col("event_type") == "click").select("event_id", shift_hours(F.col("ts"), -24).alias("target"))
    return fc, ref


def _nearest_sql(limit: str) -> str:
    return f"""WITH c AS (SELECT event_id, ts - INTERVAL 24 HOUR AS target FROM events WHERE event_type = 'click'),
      r AS (SELECT event_id AS ref_id, ts AS ref_ts FROM events WHERE event_type = 'view')
      SELECT event_id, first(ref_id ORDER BY abs(epoch_us(ref_ts) - epoch_us(target)), ref_ts, ref_id) AS match_id,
        min(abs(epoch_us(ref_ts) - epoch_us(target))) / 1000000.0 AS match_gap_s
      FROM c, r {limit} GROUP BY event_id"""


@query(
    "event_id:i match_id:i match_gap_s:d",
    _nearest_sql("WHERE ref_ts BETWEEN target - INTERVAL 10 MINUTE AND target + INTERVAL 10 MINUTE"),
)
def asof_nearest(v: Views):
    fc, ref = _clock(v)
    return pairing.nearest_time(fc, ref, [], "target", "ref_ts", "ref_id", 1 / 6)


@query("event_id:i match_id:i match_gap_s:d", _nearest_sql(""))
def asof_unbounded(v: Views):
    fc, ref = _clock(v)
    return pairing.nearest_time(fc, ref, [], "target", "ref_ts", "ref_id")


_REFERENCE_SQL = "SELECT variable, y, x, init_time, value AS ref_value FROM v_grid WHERE source = 'N' AND lead_hours = 0"


def _daily(v: Views):
    """Cells by ship day, so that valid times of whole-day leads meet reference days."""
    li = v.table("lineitem")
    day = F.col("l_shipdate").cast("date").cast("timestamp_ntz")
    lead = F.get(F.array(*[F.lit(h) for h in (0, 6, 12, 24, 48, 96, 192)]), F.col("l_linenumber") - 1)
    keys = [
        F.col("l_returnflag").alias("source"), day.alias("init_time"), lead.alias("lead_hours"),
        (F.col("l_suppkey") % 2).cast("int").alias("y"), (F.col("l_partkey") % 2).cast("int").alias("x"),
    ]
    means = li.groupBy(*keys).agg(
        F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax")
    )
    return means.unpivot(["source", "init_time", "lead_hours", "y", "x"], VARIABLES, "variable", "value")


_DAILY_SQL = """SELECT source, init_time, lead_hours, y, x, unnest(['qty', 'price', 'disc', 'tax']) AS variable, unnest([qty, price, disc, tax]) AS value FROM (SELECT l_returnflag AS source, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS init_time,
  CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 6 WHEN 3 THEN 12 WHEN 4 THEN 24 WHEN 5 THEN 48 WHEN 6 THEN 96 WHEN 7 THEN 192 END AS lead_hours,
  CAST(l_suppkey % 2 AS INTEGER) AS y, CAST(l_partkey % 2 AS INTEGER) AS x, avg(l_quantity) AS qty, avg(l_extendedprice) AS price, avg(l_discount) AS disc, avg(l_tax) AS tax
  FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "source:s init_time:t lead_hours:i variable:s y:i x:i valid_time:t value:d ref_value:d",
    f"""WITH d AS MATERIALIZED ({_DAILY_SQL}),
        a AS MATERIALIZED (SELECT *, epoch(init_time) + 3600 * lead_hours AS due FROM d WHERE source <> 'N'),
        r AS MATERIALIZED (SELECT variable, y, x, epoch(init_time) AS due, init_time AS valid_time, value AS ref_value FROM d WHERE source = 'N' AND lead_hours = 0)
        SELECT source, init_time, lead_hours, variable, y, x, valid_time, value, ref_value FROM a JOIN r USING (variable, y, x, due)""",
)
def pair_valid_time(v: Views):
    d = _daily(v)
    reference = d.where((F.col("source") == "N") & (F.col("lead_hours") == 0))
    return pairing.pair_valid_time(d.where(F.col("source") != "N"), reference)


@query(
    "source:s init_time:t lead_hours:i y:i x:i channel:i value:d",
    f"""WITH d AS ({_DAILY_SQL}), p AS (
          SELECT a.*, r.value AS prior_value FROM d a JOIN d r ON r.source = 'N' AND r.lead_hours = 0 AND r.variable = a.variable AND r.y = a.y AND r.x = a.x
          AND r.init_time = a.init_time + to_hours(a.lead_hours) - INTERVAL 24 HOUR WHERE a.source <> 'N'),
        s AS (SELECT variable, avg(value) AS mean, stddev_pop(value) AS std FROM d GROUP BY 1)
        SELECT source, init_time, lead_hours, y, x, {_INDEX} + unnest([0, 4]) AS channel,
          unnest([(prior_value - mean) / std, (value - mean) / std]) AS value FROM p JOIN s USING (variable)""",
)
def pair_cross_source(v: Views):
    """Forecast present, reference prior one day before the valid time, composed as prior and present channels."""
    d = _daily(v)
    reference = d.where((F.col("source") == "N") & (F.col("lead_hours") == 0))
    pairs = pairing.pair_cross_source(d.where(F.col("source") != "N"), reference, 24).drop("prior_time")
    return compose.compose(pairs, "concat", VARIABLES, stats.field_stats(d))


