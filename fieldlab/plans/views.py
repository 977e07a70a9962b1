"""Cells, snapshots, vectors, scores and file names derived from the given tables, in Spark and in SQL.

Everything is computed by Spark from whole tables, so the work grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions.keyed import uniform_value
from fieldlab.functions.reuse import materialize, spread
from fieldlab.operators.critic import keyed_weights, score_critic

VARIABLES = ["qty", "price", "disc", "tax"]
CHANNELS = ["t", "u", "v", "p"]
LEADS = [0, 6, 12, 24, 48, 96, 192]
FORECAST_LEADS = [6, 12, 24, 48, 96, 192]
STEMS = [
    "graphcast", "pangu", "fuxi", "keisler", "neuralgcm", "sphericalcnn", "IFS-HRES", "ERA5_forecast", "my-new_model2b", "Pangu_Weather",
]
TRAIN = [["1996-01-01", "1998-12-31"], ["2000-01-01", "2000-12-31"]]
TEST = [[None, "1995-12-31"], ["1999-01-01", "1999-12-31"], ["2001-01-01", None]]
DIM = 64
CRITICS = 3


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def grid(self) -> DataFrame:
        """Cells on a 4 x 8 grid by return flag (source), quarter and lead; gaps occur."""
        return self._grid(4, 8)

    @cached_property
    def stored_grid(self) -> DataFrame:
        """`grid` written once, as an archive would be, for queries that read it several times."""
        return materialize(self.grid)

    @cached_property
    def levels(self) -> DataFrame:
        """As `grid`, with a pressure level by line status; source R has no levels."""
        level = F.when(F.col("l_returnflag") == "R", None).when(F.col("l_linestatus") == "O", 850).otherwise(500)
        return self._grid(4, 8, level.cast("int"))

    @cached_property
    def fine(self) -> DataFrame:
        """Cells on an 8 x 16 grid by quarter, one source."""
        li = self.table("lineitem")
        keys = [
            F.lit("fine").alias("source"),
            self._quarter(F.col("l_shipdate")).alias("init_time"),
            (F.col("l_suppkey") % 8).cast("int").alias("y"),
            (F.col("l_partkey") % 16).cast("int").alias("x"),
        ]
        return self._averaged(li.groupBy(*keys), ["source", "init_time", "y", "x"])

    @cached_property
    def vec(self) -> DataFrame:
        leads = F.array(*[F.lit(h) for h in FORECAST_LEADS])
        return spread(self.table("embeddings"), "vec_id").select(
            F.col("vec_id").alias("sample_id"),
            F.when(F.col("label") < 5, "ref").otherwise("cand").alias("source"),
            F.concat(F.lit("m"), F.col("label")).alias("model"),
            F.get(leads, (F.col("vec_id") % 6).cast("int")).alias("lead_hours"),
            F.when(F.col("label") < 5, 1).otherwise(0).alias("label"),
            F.col("embedding").cast("array<double>").alias("vec"),
        )

    @cached_property
    def ref(self) -> DataFrame:
        return self.vec.where(F.col("source") == "ref")

    @cached_property
    def cand(self) -> DataFrame:
        return self.vec.where(F.col("source") == "cand")

    @cached_property
    def snap8(self) -> DataFrame:
        """One 8 x 8 field per sample, of one of two variables."""
        name = F.concat(F.lit("f"), (F.col("sample_id") % 2).cast("string"))
        return self.vec.select(
            "sample_id", "source", name.alias("variable"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("vec").alias("values")
        )

    @cached_property
    def snap4(self) -> DataFrame:
        """Four 4 x 4 fields t, u, v, p per sample."""
        parts = [F.struct(F.lit(c).alias("variable"), F.slice("vec", 16 * i + 1, 16).alias("values")) for i, c in enumerate(CHANNELS)]
        return self.vec.select("sample_id", "source", F.explode(F.array(*parts)).alias("_f")).select(
            "sample_id", "source", "_f.variable", F.lit(4).alias("h"), F.lit(4).alias("w"), "_f.values"
        )

    @cached_property
    def series(self) -> DataFrame:
        """One-cell series: mean event value per type and six hours."""
        ts = F.col("ts")
        bucket = ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.floor(F.hour(ts) / 6).cast("int") * 6)
        cells = self.table("events").groupBy(F.col("event_type").alias("source"), bucket.alias("init_time"))
        return cells.agg(F.avg("value").alias("value")).select(
            "source", "init_time", F.lit(0).alias("lead_hours"), F.lit("value").alias("variable"), F.lit(0).alias("y"), F.lit(0).alias("x"), "value"
        )

    @cached_property
    def logit(self) -> DataFrame:
        critics = {f"c{c}": (keyed_weights(c, DIM), 0.0) for c in range(CRITICS)}
        return score_critic(self.vec, critics)

    @cached_property
    def files(self) -> DataFrame:
        """Forecast file names by order year and customer."""
        stem = F.get(F.array(*[F.lit(s) for s in STEMS]), (F.col("o_custkey") % len(STEMS)).cast("int"))
        year = F.year("o_orderdate").cast("string")
        path = F.concat(F.lit("/data/"), stem, F.lit("_6steps_surf_1.5deg_"), year, F.lit("-01-01_"), year, F.lit("-12-31.nc"))
        return self.table("orders").select(path.alias("path")).distinct()

    def _quarter(self, ts):
        return F.make_date(F.year(ts), F.quarter(ts) * 3 - 2, F.lit(1)).cast("timestamp_ntz")

    def _grid(self, h: int, w: int, level=None) -> DataFrame:
        li = self.table("lineitem")
        keys = [
            F.col("l_returnflag").alias("source"),
            self._quarter(F.col("l_shipdate")).alias("init_time"),
            F.get(F.array(*[F.lit(x) for x in LEADS]), F.col("l_linenumber") - 1).alias("lead_hours"),
            (F.col("l_suppkey") % h).cast("int").alias("y"),
            (F.col("l_partkey") % w).cast("int").alias("x"),
        ]
        names = ["source", "init_time", "lead_hours", "y", "x"]
        if level is not None:
            keys.append(level.alias("level"))
            names.append("level")
        cells = self._averaged(li.groupBy(*keys), names)
        return cells.withColumn("lat", 67.5 - 45.0 * F.col("y")).withColumn("lon", 45.0 * F.col("x"))

    def _averaged(self, grouped, names) -> DataFrame:
        means = grouped.agg(
            F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax")
        )
        return means.unpivot(names, VARIABLES, "variable", "value")


# --- the same views in SQL ----------------------------------------------------------------------------------------------------


def key_sql(*parts) -> str:
    return " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)


def digest_sql(*parts) -> str:
    return f"md5({key_sql(*parts)})"


def uniform_sql(*parts) -> str:
    return f"(CAST('0x' || substr({digest_sql(*parts)}, 1, 13) AS BIGINT) / 4503599627370496.0)"


def normal_sql(*parts) -> str:
    d = digest_sql(*parts)
    u1 = f"(CAST('0x' || substr({d}, 1, 13) AS BIGINT) / 4503599627370496.0)"
    u2 = f"(CAST('0x' || substr({d}, 17, 13) AS BIGINT) / 4503599627370496.0)"
    return f"(sqrt(-2.0 * ln({u1} + 0.5 / 4503599627370496.0)) * cos(2.0 * pi() * {u2}))"


def ranges_sql(ranges) -> str:
    rows = ", ".join(f"({_date(a)}, {_date(b)})" for a, b in ranges)
    return f"(VALUES {rows}) AS r(lo, hi)"


def in_range_sql(time: str = "init_time") -> str:
    return f"(r.lo IS NULL OR {time} >= r.lo) AND (r.hi IS NULL OR {time} < r.hi + INTERVAL 1 DAY)"


def _date(x) -> str:
    return "CAST(NULL AS TIMESTAMP)" if x is None else f"TIMESTAMP '{x}'"


_LEAD = "CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN {h}" for i, h in enumerate(LEADS)) + " END"
_MEANS = "avg(l_quantity) AS qty, avg(l_extendedprice) AS price, avg(l_discount) AS disc, avg(l_tax) AS tax"
_LONG = "unnest(['qty', 'price', 'disc', 'tax']) AS variable, unnest([qty, price, disc, tax]) AS value"
_WEIGHTS = [f"[{', '.join(repr(2.0 * uniform_value('critic', c, i) - 1.0) for i in range(DIM))}]" for c in range(CRITICS)]
_STEMS = "[" + ", ".join(f"'{s}'" for s in STEMS) + "]"

SQL_VIEWS = {
    "v_grid": f"""SELECT source, init_time, lead_hours, y, x, 67.5 - 45.0 * y AS lat, 45.0 * x AS lon, {_LONG} FROM (
        SELECT l_returnflag AS source, CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS init_time, {_LEAD} AS lead_hours,
               CAST(l_suppkey % 4 AS INTEGER) AS y, CAST(l_partkey % 8 AS INTEGER) AS x, {_MEANS}
        FROM lineitem GROUP BY 1, 2, 3, 4, 5)""",
    "v_levels": f"""SELECT source, init_time, lead_hours, y, x, level, 67.5 - 45.0 * y AS lat, 45.0 * x AS lon, {_LONG} FROM (
        SELECT l_returnflag AS source, CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS init_time, {_LEAD} AS lead_hours,
               CAST(l_suppkey % 4 AS INTEGER) AS y, CAST(l_partkey % 8 AS INTEGER) AS x,
               CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'O' THEN 850 ELSE 500 END AS level, {_MEANS}
        FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6)""",
    "v_fine": f"""SELECT source, init_time, y, x, {_LONG} FROM (
        SELECT 'fine' AS source, CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS init_time,
               CAST(l_suppkey % 8 AS INTEGER) AS y, CAST(l_partkey % 16 AS INTEGER) AS x, {_MEANS}
        FROM lineitem GROUP BY 1, 2, 3, 4)""",
    "v_vec": """SELECT vec_id AS sample_id, CASE WHEN label < 5 THEN 'ref' ELSE 'cand' END AS source, 'm' || label AS model,
        [6, 12, 24, 48, 96, 192][CAST(vec_id % 6 AS INTEGER) + 1] AS lead_hours, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label,
        CAST(embedding AS DOUBLE[]) AS vec FROM embeddings""",
    "v_dims": """SELECT sample_id, source, model, lead_hours, label, unnest(vec) AS value, unnest(range(len(vec))) AS i FROM v_vec""",
    "v_cell8": """SELECT sample_id, source, 'f' || sample_id % 2 AS variable, i // 8 AS y, i % 8 AS x, i AS pos, value FROM v_dims""",
    "v_cell4": """SELECT sample_id, source, ['t', 'u', 'v', 'p'][CAST(i // 16 AS INTEGER) + 1] AS variable,
        (i % 16) // 4 AS y, i % 4 AS x, i % 16 AS pos, value FROM v_dims""",
    "v_series": """SELECT event_type AS source, CAST(date_trunc('day', ts) AS TIMESTAMP) + to_hours(CAST(6 * (hour(ts) // 6) AS INTEGER)) AS init_time,
        0 AS lead_hours, 'value' AS variable, 0 AS y, 0 AS x, avg(value) AS value FROM events GROUP BY 1, 2""",
    "v_logit": f"""SELECT sample_id, source, model, lead_hours, label, critic, list_dot_product(vec, w) AS logit
        FROM v_vec, (VALUES {", ".join(f"('c{c}', {w})" for c, w in enumerate(_WEIGHTS))}) AS cr(critic, w)""",
    "v_files": f"""SELECT DISTINCT '/data/' || {_STEMS}[CAST(o_custkey % {len(STEMS)} AS INTEGER) + 1] || '_6steps_surf_1.5deg_'
        || year(o_orderdate) || '-01-01_' || year(o_orderdate) || '-12-31.nc' AS path FROM orders""",
    "v_axis": """SELECT source, init_time, row_number() OVER (PARTITION BY source ORDER BY init_time) - 1 AS t_idx,
        count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, init_time FROM v_grid)""",
    "v_stats": """SELECT variable, avg(value) AS mean, CASE WHEN stddev_pop(value) > 1e-8 THEN stddev_pop(value) ELSE 1.0 END AS std
        FROM v_grid GROUP BY variable""",
}
