"""Score curves, distribution distances, probes and summary statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlab.functions.keyed import uniform
from fieldlab.functions import times
from fieldlab.functions.reuse import materialize, stored
from fieldlab.operators import compose, corrupt, critic, distance, pairing, quantiles, scores, select, stats, tokens
from fieldlab.plans.assembly import BASIS
from fieldlab.plans.composition import _DSTATS, _PRIOR
from fieldlab.plans.corruption import _NOISE8, _blur_sql
from fieldlab.plans.registry import query
from fieldlab.plans.views import CHANNELS, CRITICS, DIM, TEST, TRAIN, VARIABLES, Views, digest_sql, in_range_sql, ranges_sql

_W4 = [2.0 * w for w in critic.keyed_weights(9, 4)]
_REAL_T = "-exp(least(-logit, 50))"


# --- curves -------------------------------------------------------------------------------------------------------------------


@query("critic:s source:s lead_hours:i mean_logit:d std_logit:d n:i", """SELECT critic, source, lead_hours, avg(logit) AS mean_logit,
       stddev_pop(logit) AS std_logit, count(*) AS n FROM v_logit GROUP BY 1, 2, 3""")
def logits_by_lead(v: Views):
    return scores.logit_curve(v.logit, ["critic", "source", "lead_hours"])


_BLURRED_SQL = " UNION ALL ".join(
    f"SELECT sample_id, y * 8 + x AS pos, 'blur' AS disturbance, {x} AS level, value FROM ({_blur_sql('SELECT * FROM v_cell8', x)})"
    for x in corrupt.DISTURBANCE_LEVELS["blur"] if x > 0
)
_SHARES = "(SELECT unnest([0, 0.05, 0.15, 0.3, 0.5]) AS l)"


@query(
    "critic:s disturbance:s level:d mean_logit:d std_logit:d n:i",
    f"""WITH f AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, min(value) OVER w AS lo, max(value) OVER w AS hi,
                stddev_pop(value) OVER (PARTITION BY variable) AS std, row_number() OVER (PARTITION BY sample_id ORDER BY
                {digest_sql(0, "'dpick'", "sample_id", "variable", "pos")}) AS r FROM v_cell8 WINDOW w AS (PARTITION BY sample_id)),
        p AS (SELECT sample_id, p, row_number() OVER (PARTITION BY sample_id ORDER BY {digest_sql(0, "'dpatch'", "sample_id", "'f' || sample_id % 2", "p")}) AS pr
              FROM (SELECT sample_id, unnest(range(16)) AS p FROM v_vec)),
        g AS ({_blur_sql(f"SELECT sample_id, y, x, {_NOISE8.format('dgrf')} AS value FROM v_cell8", 2.0)}),
        z AS (SELECT sample_id, y * 8 + x AS pos, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS zz FROM g WINDOW w AS (PARTITION BY sample_id)),
        d AS (SELECT sample_id, pos, 'quant' AS disturbance, l AS level,
                CASE WHEN l >= 256 OR hi = lo THEN value ELSE round_even((value - lo) / (hi - lo) * (l - 1), 0) / (l - 1) * (hi - lo) + lo END AS value
              FROM f, (SELECT unnest([256, 64, 32, 16, 8, 4]) AS l)
              UNION ALL SELECT sample_id, pos, 'noise', l, value + l * std * {_NOISE8.format('dnoise')} FROM f, (SELECT unnest([0, 0.1, 0.3, 0.6, 1.0]) AS l)
              UNION ALL SELECT f.sample_id, f.pos, 'grf', l, value + l * std * zz FROM f JOIN z USING (sample_id, pos), (SELECT unnest([0, 0.1, 0.3, 0.6, 1.0]) AS l)
              UNION ALL SELECT sample_id, pos, 'replace', l, CASE WHEN r <= floor(l * 64) THEN m + sd * {_NOISE8.format('dfresh')} ELSE value END FROM f, {_SHARES}
              UNION ALL SELECT f.sample_id, pos, 'patch', l, CASE WHEN pr <= floor(l * 16) THEN m ELSE value END
              FROM f JOIN p ON p.sample_id = f.sample_id AND p.p = (y // 2) * 4 + x // 2, {_SHARES}
              UNION ALL SELECT sample_id, pos, 'blur', 0, value FROM f UNION ALL {_BLURRED_SQL}),
        s AS (SELECT c, sample_id, disturbance, level, sum(value * w[CAST(pos AS INTEGER) + 1]) AS logit FROM d,
              (VALUES {", ".join(f"('c{c}', {critic.keyed_weights(c, DIM)})" for c in range(CRITICS))}) AS cr(c, w) GROUP BY 1, 2, 3, 4)
        SELECT c AS critic, disturbance, level, avg(logit) AS mean_logit, stddev_pop(logit) AS std_logit, count(*) AS n FROM s GROUP BY 1, 2, 3""",
)
def logits_by_disturbance(v: Views):
    """Every sample at every level of all six disturbances, scored by every critic."""
    fields = v.snap8.join(stats.snapshot_stats(v.snap8).select("variable", "std"), "variable")
    swept = corrupt.disturbance_sweep(fields, patch={"patch": 2})
    critics = {f"c{c}": (critic.keyed_weights(c, DIM), 0.0) for c in range(CRITICS)}
    scored = critic.score_critic(swept.select("sample_id", "disturbance", "level", "values"), critics, vec="values")
    return scores.logit_curve(scored, ["critic", "disturbance", "level"])


@query(
    "band_mean:d band_std:d n_critics:i",
    """SELECT avg(m) AS band_mean, avg(s) AS band_std, count(*) AS n_critics FROM (
       SELECT critic, avg(logit) AS m, stddev_pop(logit) AS s FROM v_logit WHERE label = 1 GROUP BY critic)""",
)
def reference_band(v: Views):
    return scores.reference_band(v.logit.where(F.col("label") == 1))


@query(
    "critic:s lead_hours:i mean_logit:d std_logit:d base_mean:d base_std:d",
    """SELECT a.*, base_mean, base_std FROM
       (SELECT critic, lead_hours, avg(logit) AS mean_logit, stddev_pop(logit) AS std_logit FROM v_logit WHERE model = 'm5' GROUP BY 1, 2) a
       LEFT JOIN (SELECT critic AS c, lead_hours AS l, avg(logit) AS base_mean, stddev_pop(logit) AS base_std FROM v_logit
                  WHERE model = 'm9' AND lead_hours > 6 GROUP BY 1, 2) b ON c = a.critic AND l = a.lead_hours""",
)
def baseline_curve(v: Views):
    base = v.logit.where((F.col("model") == "m9") & (F.col("lead_hours") > 6))
    return scores.baseline_curve(v.logit.where(F.col("model") == "m5"), base)


@query(
    "critic:s model:s mean:d stderr:d n:i",
    f"""SELECT critic, model, avg({_REAL_T}) AS mean, coalesce(stddev_samp({_REAL_T}) / sqrt(count(*)), 0) AS stderr, count(*) AS n
        FROM v_logit GROUP BY 1, 2""",
)
def expectation_stderr(v: Views):
    return scores.expectation(v.logit, ["critic", "model"], scores.reverse_kl_critic)


def _snapshot_logits(v: Views):
    """Test-range snapshots scored by a fixed linear critic on the field means of train-normalized variables."""
    z = stats.normalize(select.select_time_ranges(v.stored_grid, TEST), stats.train_stats(v.stored_grid, TRAIN, VARIABLES))
    means = [F.avg(F.when(F.col("variable") == name, F.col("value"))) for name in VARIABLES]
    vec = F.array(*[F.coalesce(m, F.lit(0.0)) for m in means])
    fields = z.groupBy("source", "init_time", "lead_hours").agg(vec.alias("vec"))
    return materialize(critic.score_critic(fields, {"fixed": (_W4, 0.0)}))


@query(
    "source:s lead_hours:i score:d stderr:d n:i",
    f"""WITH s AS (SELECT variable, avg(value) AS mean, CASE WHEN stddev_pop(value) > 1e-8 THEN stddev_pop(value) ELSE 1 END AS std
          FROM v_grid, {ranges_sql(TRAIN)} WHERE {in_range_sql()} GROUP BY 1),
        m AS (SELECT source, init_time, lead_hours, variable, avg((value - mean) / std) AS z FROM v_grid JOIN s USING (variable), {ranges_sql(TEST)}
          WHERE {in_range_sql()} GROUP BY 1, 2, 3, 4),
        l AS (SELECT source, init_time, lead_hours, sum(z * {_W4}[list_position(['qty', 'price', 'disc', 'tax'], variable)]) AS logit
          FROM m GROUP BY 1, 2, 3),
        r AS (SELECT avg({_REAL_T}) AS m, coalesce(stddev_samp({_REAL_T}) / sqrt(count(*)), 0) AS e FROM l WHERE source = 'N' AND lead_hours = 0)
        SELECT l.source, l.lead_hours, r.m - avg(logit - 1) AS score, sqrt(r.e * r.e + pow(coalesce(stddev_samp(logit) / sqrt(count(*)), 0), 2)) AS stderr,
          count(*) AS n FROM l, r WHERE l.source <> 'N' AND l.lead_hours > 0 GROUP BY l.source, l.lead_hours, r.m, r.e""",
)
def reverse_kl_by_lead(v: Views):
    scored = _snapshot_logits(v)
    reference = scored.where((F.col("source") == "N") & (F.col("lead_hours") == 0))
    return scores.reverse_kl(reference, scored.where((F.col("source") != "N") & (F.col("lead_hours") > 0)), ["source", "lead_hours"])


@query(
    "critic:s model:s lead_hours:i score:d stderr:d n:i",
    f"""WITH r AS (SELECT critic, avg({_REAL_T}) AS m, coalesce(stddev_samp({_REAL_T}) / sqrt(count(*)), 0) AS e FROM v_logit WHERE label = 1 GROUP BY 1)
        SELECT l.critic, model, lead_hours, r.m - avg(logit - 1) AS score, sqrt(r.e * r.e + pow(coalesce(stddev_samp(logit) / sqrt(count(*)), 0), 2)) AS stderr,
          count(*) AS n FROM v_logit l JOIN r ON r.critic = l.critic WHERE label = 0 GROUP BY l.critic, model, lead_hours, r.m, r.e""",
)
def reverse_kl_per_critic(v: Views):
    """Every critic has a real term of its own."""
    return scores.reverse_kl(v.logit.where("label = 1"), v.logit.where("label = 0"), ["critic", "model", "lead_hours"], real_by=["critic"])


_CW = f"{critic.keyed_weights(0, DIM)}"


@query(
    "corruption:s severity:d score:d stderr:d n:i",
    f"""WITH r AS (SELECT a.*, CASE a.variable WHEN 't' THEN 0 WHEN 'u' THEN 16 WHEN 'v' THEN 32 ELSE 48 END + a.pos AS k, b.value AS other
          FROM v_cell4 a LEFT JOIN v_cell4 b ON a.sample_id = b.sample_id AND a.pos = b.pos
          AND ((a.variable = 'u' AND b.variable = 'v') OR (a.variable = 'v' AND b.variable = 'u')) WHERE a.source = 'ref'),
        q AS (SELECT sample_id, 'wind_rotation' AS corruption, s.i / 4.0 AS severity, k,
            CASE variable WHEN 'u' THEN cos(s.i * pi() / 8) * value - sin(s.i * pi() / 8) * other
              WHEN 'v' THEN sin(s.i * pi() / 8) * other + cos(s.i * pi() / 8) * value ELSE value END AS value FROM r, range(5) AS s(i)
          UNION ALL SELECT sample_id, 'noise', s.i / 4.0, k, value + s.i / 4.0 * 0.25 * {_NOISE8.format('noise')} FROM r, range(5) AS s(i)),
        l AS (SELECT corruption, severity, sample_id, sum(value * {_CW}[CAST(k AS INTEGER) + 1]) AS logit FROM q GROUP BY 1, 2, 3),
        x AS (SELECT avg({_REAL_T}) AS m, stddev_samp({_REAL_T}) / sqrt(count(*)) AS e FROM v_logit WHERE critic = 'c0' AND label = 1)
        SELECT corruption, severity, x.m - avg(logit - 1) AS score, sqrt(x.e * x.e + pow(stddev_samp(logit) / sqrt(count(*)), 2)) AS stderr,
          count(*) AS n FROM l, x GROUP BY corruption, severity, x.m, x.e""",
)
def reverse_kl_by_severity(v: Views):
    """Reference samples along a ladder up to severity 1, scored by the first critic."""
    types = ["noise", "wind_rotation"]
    clean = v.snap4.where(F.col("source") == "ref")
    swept = corrupt.apply_sweep(corrupt.ladder_sweep(clean, types, 5, 1.0), types)
    vecs = compose.flatten_channels(swept, CHANNELS, ("sample_id", "corruption", "severity"))
    scored = critic.score_critic(vecs, {"c0": (critic.keyed_weights(0, DIM), 0.0)})
    reference = v.logit.where((F.col("critic") == "c0") & (F.col("label") == 1))
    return scores.reverse_kl(reference, scored, ["corruption", "severity"])


@query(
    "critic:s loss:d accuracy:d n:i",
    """SELECT critic, avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))) AS loss,
       avg(CASE WHEN (logit > 0) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM v_logit GROUP BY 1""",
)
def bce_accuracy(v: Views):
    return scores.bce_accuracy(v.logit, ["critic"])


@query("critic:s lead_hours:i realism:d n:i", "SELECT critic, lead_hours, avg(1 / (1 + exp(-logit))) AS realism, count(*) AS n FROM v_logit GROUP BY 1, 2")
def sigmoid_realism(v: Views):
    return scores.sigmoid_realism(v.logit, ["critic", "lead_hours"])


def _top_sql(name: str, order: str, cond: str = "true") -> str:
    return f"""SELECT '{name}' AS category, row_number() OVER (ORDER BY {order}, sample_id) AS rank, sample_id, logit, label
        FROM v_logit WHERE critic = 'c0' AND {cond} QUALIFY rank <= 3"""


@query(
    "category:s rank:i sample_id:i logit:d label:i",
    " UNION ALL ".join(
        [_top_sql("Realest", "-logit"), _top_sql("Most Uncertain", "abs(logit)"), _top_sql("Best Fakes", "-logit", "label = 0"), _top_sql("Worst Fakes", "logit", "label = 0")]
    ),
)
def topk_samples(v: Views):
    return scores.topk_samples(v.logit.where(F.col("critic") == "c0").select("sample_id", "logit", "label"))


@query(
    "critic:s source:s lead_hours:i value:d relative:d",
    """WITH c AS (SELECT critic, source, lead_hours, avg(logit) AS value FROM v_logit GROUP BY 1, 2, 3)
       SELECT *, (value - first_value(value) OVER w) / (abs(first_value(value) OVER w) + 1e-8) AS relative FROM c
       WINDOW w AS (PARTITION BY critic, source ORDER BY lead_hours)""",
)
def curve_normalize(v: Views):
    curve = scores.logit_curve(v.logit, ["critic", "source", "lead_hours"]).withColumnRenamed("mean_logit", "value")
    return scores.normalize_curve(curve, ["critic", "source"], "lead_hours", "value")


# --- summaries ----------------------------------------------------------------------------------------------------------------


@query("variable:s init_time:t mean:d", "SELECT variable, init_time, avg(value) AS mean FROM v_fine GROUP BY 1, 2")
def global_mean_series(v: Views):
    return v.fine.groupBy("variable", "init_time").agg(F.avg("value").alias("mean"))


@query(
    "variable:s lo:d hi:d",
    """SELECT variable, CASE WHEN variable IN ('u', 'v') THEN -greatest(abs(a), abs(b)) ELSE a END AS lo,
         CASE WHEN variable IN ('u', 'v') THEN greatest(abs(a), abs(b)) ELSE b END AS hi FROM (
       SELECT variable, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM v_cell4 GROUP BY 1
       UNION ALL SELECT variable, quantile_cont(value, 0.01), quantile_cont(value, 0.99) FROM v_grid GROUP BY 1)""",
)
def percentile_limits(v: Views):
    cells = compose.to_cells(v.snap4).select("variable", "value").unionByName(v.grid.select("variable", "value"))
    return quantiles.display_limits(materialize(cells), ["variable"], "value", 0.01, 0.99, F.col("variable").isin("u", "v"))


# --- moments and distances ----------------------------------------------------------------------------------------------------


@query("source:s i:i mean:d n:i", "SELECT source, i, avg(value) AS mean, count(*) AS n FROM v_dims GROUP BY 1, 2")
def mean_vector(v: Views):
    return distance.mean_vector(v.vec, ["source"])


@query(
    "source:s i:i j:i cov:d",
    """SELECT a.source, a.i, b.i AS j, covar_samp(a.value, b.value) AS cov FROM v_dims a JOIN v_dims b ON a.sample_id = b.sample_id
       GROUP BY 1, 2, 3""",
)
def covariance(v: Views):
    rows = distance.covariance_rows(v.vec, ["source"])
    return rows.select("source", "i", F.posexplode("row").alias("j", "cov"))


@query("model:s n:i n_ref:i mean_sq:d trace_ref:d trace:d fid:d")
def frechet(v: Views):
    return distance.frechet(v.ref, v.cand, ["model"])


@query(
    "model:s mean_sq:d trace_ref:d trace:d",
    """WITH r AS (SELECT i, avg(value) AS rm, var_samp(value) AS rv FROM v_dims WHERE source = 'ref' GROUP BY 1),
       c AS (SELECT model, i, avg(value) AS m, var_samp(value) AS v FROM v_dims WHERE source = 'cand' GROUP BY 1, 2)
       SELECT model, sum((m - rm) * (m - rm)) AS mean_sq, sum(rv) AS trace_ref, sum(v) AS trace FROM c JOIN r USING (i) GROUP BY 1""",
)
def frechet_terms(v: Views):
    return distance.frechet_terms(v.ref, v.cand, ["model"])


_PLANE_SQL = "SELECT sample_id, source, model, vec[1] + vec[3] AS x, vec[2] - 0.5 * vec[1] AS y FROM v_vec"


def _plane(vectors):
    """Two components per vector that are correlated."""
    at = [F.get("vec", F.lit(k)) for k in range(3)]
    return vectors.withColumn("vec", F.array(at[0] + at[2], at[1] - 0.5 * at[0]))


@query(
    "model:s n:i n_ref:i fid:d",
    f"""WITH p AS ({_PLANE_SQL}), m AS (SELECT CASE WHEN source = 'ref' THEN 'ref' ELSE model END AS g, count(*) AS n, avg(x) AS mx, avg(y) AS my,
          var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM p GROUP BY 1)
        SELECT s.g AS model, s.n, r.n AS n_ref, (r.mx - s.mx) ** 2 + (r.my - s.my) ** 2 + r.a + r.c + s.a + s.c - 2 * sqrt(r.a * s.a + 2 * r.b * s.b
          + r.c * s.c + 2 * sqrt((r.a * r.c - r.b * r.b) * (s.a * s.c - s.b * s.b))) AS fid FROM m s, m r WHERE r.g = 'ref' AND s.g <> 'ref'""",
)
def frechet_plane(v: Views):
    return distance.frechet_plane(_plane(v.ref), _plane(v.cand), ["model"])


@query("model:s lead_hours:i n:i n_ref:i fid:d")
def fid_by_lead(v: Views):
    return distance.frechet(v.ref, v.cand, ["model", "lead_hours"])


_PAIRS_SQL = """r AS (SELECT sample_id, vec FROM v_vec WHERE source = 'ref'), c AS (SELECT model, sample_id, vec FROM v_vec WHERE source = 'cand'),
  xx AS (SELECT list_distance(a.vec, b.vec) ** 2 AS d FROM r a JOIN r b ON a.sample_id <> b.sample_id),
  yy AS (SELECT a.model, list_distance(a.vec, b.vec) ** 2 AS d FROM c a JOIN c b ON a.model = b.model AND a.sample_id <> b.sample_id),
  xy AS (SELECT c.model, list_distance(r.vec, c.vec) ** 2 AS d FROM r, c)"""
_GAMMA_SQL = """g AS (SELECT model, 1 / (2 * quantile_disc(d, 0.5) + 1e-6) AS gamma FROM (
    SELECT model, d FROM yy UNION ALL SELECT model, d FROM xy UNION ALL SELECT m.model, xx.d FROM xx, (SELECT DISTINCT model FROM c) m) GROUP BY 1)"""


@query(
    "kind:s g:s n:i mean:d min:d max:d",
    f"""WITH {_PAIRS_SQL} SELECT 'ref' AS kind, NULL AS g, count(*) AS n, avg(d) AS mean, min(d) AS min, max(d) AS max FROM xx
        UNION ALL SELECT 'cand', model, count(*), avg(d), min(d), max(d) FROM yy GROUP BY model
        UNION ALL SELECT 'cross', model, count(*), avg(d), min(d), max(d) FROM xy GROUP BY model""",
)
def pairwise_sqdist(v: Views):
    return distance.sqdist_summary(v.ref, v.cand, "model", "sample_id")


@query("model:s gamma:d", f"WITH {_PAIRS_SQL}, {_GAMMA_SQL} SELECT * FROM g")
def mmd_gamma(v: Views):
    grid, _ = distance.tiles(v.ref, v.cand, "model", "sample_id")
    return distance.mmd_gammas(grid).withColumnRenamed("g", "model")


@query(
    "model:s n_ref:i n:i gamma:d mmd:d",
    f"""WITH {_PAIRS_SQL}, {_GAMMA_SQL}, s AS (SELECT count(*) AS n_ref FROM r), k AS (SELECT model, count(*) AS n FROM c GROUP BY 1)
        SELECT g.model, n_ref, n, gamma, (SELECT sum(exp(-g.gamma * d)) FROM xx) / (n_ref * (n_ref - 1))
          + (SELECT sum(exp(-g.gamma * d)) FROM yy WHERE yy.model = g.model) / (n * (n - 1))
          - 2 * (SELECT sum(exp(-g.gamma * d)) FROM xy WHERE xy.model = g.model) / (n_ref * n) AS mmd
        FROM g JOIN k ON k.model = g.model, s""",
)
def mmd_rbf(v: Views):
    return distance.mmd_rbf(v.ref, v.cand, "model", "sample_id")


@query(
    "half:s n_ref:i n:i gamma:d mmd:d",
    f"""WITH h AS (SELECT sample_id, vec, row_number() OVER (ORDER BY {digest_sql(2, "'half'", 'sample_id')}, sample_id) - 1 AS p, count(*) OVER () // 2 AS k
          FROM v_vec WHERE source = 'ref'),
        r AS (SELECT sample_id, vec FROM h WHERE p < k), c AS (SELECT sample_id, vec FROM h WHERE p >= k AND p < 2 * k),
        xx AS (SELECT list_distance(a.vec, b.vec) ** 2 AS d FROM r a JOIN r b ON a.sample_id <> b.sample_id),
        yy AS (SELECT list_distance(a.vec, b.vec) ** 2 AS d FROM c a JOIN c b ON a.sample_id <> b.sample_id),
        xy AS (SELECT list_distance(r.vec, c.vec) ** 2 AS d FROM r, c),
        g AS (SELECT 1 / (2 * quantile_disc(d, 0.5) + 1e-6) AS gamma FROM (SELECT d FROM xx UNION ALL SELECT d FROM yy UNION ALL SELECT d FROM xy)),
        s AS (SELECT count(*) AS n FROM r)
        SELECT 'b' AS half, n AS n_ref, n, gamma, (SELECT avg(exp(-g.gamma * d)) FROM xx) + (SELECT avg(exp(-g.gamma * d)) FROM yy)
          - 2 * (SELECT avg(exp(-g.gamma * d)) FROM xy) AS mmd FROM g, s""",
)
def mmd_self_baseline(v: Views):
    """Noise floor: one random half of the reference against the other."""
    halves = materialize(select.split_halves(v.ref, "sample_id", seed=2))
    return distance.mmd_rbf(halves.where(F.col("half") == "a"), halves.where(F.col("half") == "b"), "half", "sample_id")


@query("model:s n_ref:i n:i fid:d gamma:d mmd:d")
def real_vs_forecast(v: Views):
    """Both distances of every model to the reference, and of the reference to itself by halves."""
    halves = materialize(select.split_halves(v.ref, "sample_id", seed=2))
    own = distance.distances(halves.where(F.col("half") == "a"), halves.where(F.col("half") == "b"), "half", "sample_id")
    return distance.distances(v.ref, v.cand, "model", "sample_id").unionByName(
        own.withColumn("half", F.lit("reference halves")).withColumnRenamed("half", "model")
    )


_ENCODER = [[2.0 * w for w in critic.keyed_weights(20 + k, 8)] for k in range(2)]
_CODED = [f"sum(z * {w}[channel + 1])" for w in _ENCODER]


@query(
    "source:s lead_hours:i n:i n_ref:i fid:d",
    f"""WITH c AS (SELECT source, init_time, lead_hours, list_position(['qty', 'price', 'disc', 'tax'], variable) - 1 + k AS channel, avg(CASE k WHEN 0
            THEN (value - mean) / std ELSE greatest(least((value - prior_value - dmean) / dstd, 15), -15) END) AS z
          FROM ({_PRIOR}) JOIN v_stats USING (variable) JOIN ({_DSTATS}) USING (variable), (SELECT unnest([0, 4]) AS k) GROUP BY 1, 2, 3, 4),
        e AS (SELECT source, init_time, lead_hours, {_CODED[0]} AS x, {_CODED[1]} AS y FROM c GROUP BY 1, 2, 3),
        n AS (SELECT DISTINCT init_time AS r FROM v_grid WHERE source = 'N' AND lead_hours = 0),
        v AS (SELECT e.*, (SELECT min(abs(epoch(r) - epoch(e.init_time) - 3600 * e.lead_hours)) FROM n) AS gap FROM e WHERE source <> 'N' AND lead_hours > 0),
        h AS (SELECT *, row_number() OVER (ORDER BY {digest_sql(4, "'cap'", "strftime(init_time, '%Y-%m-%d')")}, init_time) AS i FROM e WHERE source = 'N' AND lead_hours = 0),
        m AS (SELECT source, lead_hours, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c
              FROM (SELECT source, lead_hours, x, y FROM v WHERE gap <= 30 * 86400 UNION ALL SELECT 'N', 0, x, y FROM h WHERE i <= 20) GROUP BY 1, 2)
        SELECT s.source, s.lead_hours, s.n, r.n AS n_ref, (r.mx - s.mx) ** 2 + (r.my - s.my) ** 2 + r.a + r.c + s.a + s.c - 2 * sqrt(greatest(0, r.a * s.a
          + 2 * r.b * s.b + r.c * s.c + 2 * sqrt(greatest(0, (r.a * r.c - r.b * r.b) * (s.a * s.c - s.b * s.b))))) AS fid
        FROM m s, m r WHERE r.source = 'N' AND s.source <> 'N'""",
)
def latent_pipeline(v: Views):
    """From cells to distances: priors by index, phase channels, a linear encoder on field means; the forecasts that have a reference time
    within 30 days of their valid time, against a random cap of the reference.
    """
    pairs = stored(pairing.prior_by_index(v.stored_grid, 2).drop("prior_time", "lat", "lon"))
    channels = compose.compose(pairs, "phase", VARIABLES, stats.field_stats(v.stored_grid), stats.pair_diff_stats(pairs))
    means = channels.groupBy("source", "init_time", "lead_hours").agg(*[F.coalesce(F.avg(F.when(F.col("channel") == k, F.col("value"))), F.lit(0.0)).alias(f"_{k}") for k in range(8)])
    features = F.array(*[F.col(f"_{k}") for k in range(8)])
    coded = stored(means.select("source", "init_time", "lead_hours", F.array(*[critic.dot(features, w) for w in _ENCODER]).alias("vec")))
    real = coded.where("source = 'N' and lead_hours = 0").withColumn("day", F.date_format("init_time", "yyyy-MM-dd"))
    forecast = coded.where("source <> 'N' and lead_hours > 0").withColumn("valid_time", times.valid_time(F.col("init_time"), F.col("lead_hours")))
    known = v.stored_grid.where("source = 'N' and lead_hours = 0").select(F.col("init_time").alias("at")).distinct().withColumn("id", F.lit(0))
    matched = pairing.nearest_time(forecast, known, [], "valid_time", "at", "id", 24 * 30)
    return distance.frechet_plane(select.cap_random(real, "day", 20, seed=4), matched, ["source", "lead_hours"])


def _ladder_features(v: Views, types, n_steps: int, max_severity: float):
    """Features of clean reference snapshots and of the same along a corruption ladder, in one job."""
    clean = v.snap4.where(F.col("source") == "ref")
    swept = corrupt.apply_sweep(corrupt.ladder_sweep(clean, types, n_steps, max_severity), types, patch=2)
    by = ("sample_id", "corruption", "severity")
    features = tokens.extract_features(clean, 2, CHANNELS, BASIS), tokens.extract_features(swept, 2, CHANNELS, BASIS, by=by)
    return tuple(materialize(f) for f in features)


@query("corruption:s severity:d n:i fid:d")
def fid_by_severity(v: Views):
    """Clamped distance to the clean reference; exactly 0 at severity 0."""
    clean, swept = _ladder_features(v, ["blur", "noise", "wind_rotation"], 5, 1.0)
    curve = distance.frechet(clean, swept, ["corruption", "severity"], clamp=True)
    return curve.withColumn("fid", F.when(F.col("severity") == 0, 0.0).otherwise(F.col("fid")))


@query("corruption:s severity:d fid:d gamma:d mmd:d")
def distance_ladder(v: Views):
    """Both distances for every corruption and severity."""
    clean, swept = _ladder_features(v, list(corrupt.LADDER_TYPES), 5, 2.0)
    steps = swept.withColumn("step", F.concat_ws("@", "corruption", F.col("severity").cast("string")))
    out = distance.distances(clean, steps, "step", "sample_id")
    return out.withColumn("corruption", F.split("step", "@").getItem(0)).withColumn("severity", F.split("step", "@").getItem(1).cast("double"))


# --- probe and PCA ------------------------------------------------------------------------------------------------------------


@query("sample_id:i source:s pc1:d pc2:d")
def pca2(v: Views):
    return distance.pca_2d(v.vec)


@query(
    "sample_id:i source:s pc1:d pc2:d",
    f"""WITH p AS ({_PLANE_SQL}), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM p),
          e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l FROM m),
          u AS (SELECT mx, my, (l - c) / sqrt((l - c) ** 2 + b * b) AS ux, b / sqrt((l - c) ** 2 + b * b) AS uy FROM e)
        SELECT sample_id, source, (ux * (x - mx) + uy * (y - my)) * sign(CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) AS pc1,
          (ux * (y - my) - uy * (x - mx)) * sign(CASE WHEN abs(uy) >= abs(ux) THEN -uy ELSE ux END) AS pc2 FROM p, u""",
)
def pca_plane(v: Views):
    return distance.pca_plane(_plane(v.vec))


@query("corruption:s mse:d r2:d slope:d intercept:d n:i")
def probe_fit(v: Views):
    """Per corruption: random severities, features, 80/20 split, linear probe, metrics on the test rows."""
    swept = v.snap4.withColumn("corruption", F.explode(F.array(*[F.lit(t) for t in corrupt.LADDER_TYPES])))
    swept = swept.withColumn("severity", corrupt.MAX_SEVERITY * uniform(11, "probe", F.col("corruption"), F.col("sample_id")))
    by = ("sample_id", "corruption", "severity")
    features = tokens.extract_features(corrupt.apply_sweep(swept, patch=2), 2, CHANNELS, BASIS, pool="concat", by=by)
    split = select.random_split(v.vec.select("sample_id"), "sample_id", 0.8, seed=11)
    rows = materialize(features.join(split, "sample_id"))
    out = None
    for kind in corrupt.LADDER_TYPES:
        mine = rows.where(F.col("corruption") == kind)
        scored = distance.predict_probe(distance.fit_probe(mine.where(F.col("split") == "train")), mine.where(F.col("split") == "test"))
        part = distance.probe_metrics(scored, ["corruption"], "severity", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


_PROBE_SQL = "SELECT critic AS model, model AS corruption, logit AS predicted, lead_hours / 24.0 AS truth FROM v_logit"


def _probe_rows(v: Views):
    return v.logit.select(
        F.col("critic").alias("model"), F.col("model").alias("corruption"), F.col("logit").alias("predicted"), (F.col("lead_hours") / 24.0).alias("truth")
    )


@query(
    "model:s corruption:s mse:d r2:d n:i",
    f"""SELECT model, corruption, avg((predicted - truth) ** 2) AS mse, CASE WHEN var_samp(truth) > 0 THEN 1 - avg((predicted - truth) ** 2) / var_samp(truth)
        ELSE 0 END AS r2, count(*) AS n FROM ({_PROBE_SQL}) GROUP BY 1, 2""",
)
def probe_metrics(v: Views):
    return distance.probe_metrics(_probe_rows(v), ["model", "corruption"], "truth", "predicted")


@query(
    "model:s slope:d intercept:d",
    f"SELECT model, regr_slope(predicted, truth) AS slope, regr_intercept(predicted, truth) AS intercept FROM ({_PROBE_SQL}) GROUP BY 1",
)
def probe_slope(v: Views):
    return distance.probe_metrics(_probe_rows(v), ["model"], "truth", "predicted")


@query(
    "corruption:s r2_first:d r2_second:d delta:d",
    f"""WITH m AS (SELECT model, corruption, 1 - avg((predicted - truth) ** 2) / var_samp(truth) AS r2 FROM ({_PROBE_SQL}) GROUP BY 1, 2)
        SELECT a.corruption, a.r2 AS r2_first, b.r2 AS r2_second, b.r2 - a.r2 AS delta FROM m a JOIN m b ON a.corruption = b.corruption
        WHERE a.model = 'c0' AND b.model = 'c1'""",
)
def probe_delta(v: Views):
    metrics = distance.probe_metrics(_probe_rows(v), ["model", "corruption"], "truth", "predicted")
    return distance.probe_delta(metrics, "c0", "c1")
