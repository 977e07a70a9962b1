"""Training sets, masks, file catalogs, critics and hold-out runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlab.operators import assemble, catalog, compose, critic, masks, scores, select, stats, tokens
from fieldlab.plans.registry import query
from fieldlab.functions.keyed import uniform_value
from fieldlab.functions.reuse import materialize, stored
from fieldlab.plans.views import CHANNELS, FORECAST_LEADS, TEST, TRAIN, VARIABLES, Views, digest_sql, in_range_sql, ranges_sql, uniform_sql

_LEADS = "(6, 12, 24, 48, 96, 192)"
_FAKE_SQL = f"""SELECT source, init_time, lead_hours, row_number() OVER (ORDER BY source, init_time, lead_hours) - 1 AS idx
  FROM (SELECT DISTINCT source, init_time, lead_hours FROM v_grid WHERE source <> 'N' AND lead_hours IN {_LEADS})"""
_REAL_SQL = """SELECT init_time, row_number() OVER (ORDER BY init_time) - 1 AS idx
  FROM (SELECT DISTINCT init_time FROM v_grid WHERE source = 'N' AND lead_hours = 0)"""


def _fake_cells(v: Views):
    return v.grid.where(F.col("source") != "N")


def _real_cells(v: Views):
    return v.grid.where((F.col("source") == "N") & (F.col("lead_hours") == 0))


def _epoch(v: Views, augment: bool):
    n_real = assemble.count_samples(_real_cells(v), [0])
    return assemble.balanced_epoch(v.spark, n_real, assemble.count_samples(_fake_cells(v), FORECAST_LEADS), augment)


@query("idx:i source:s init_time:t lead_hours:i", _FAKE_SQL)
def fake_index(v: Views):
    return assemble.fake_index(_fake_cells(v), FORECAST_LEADS)


_CATEGORY = f"""['forecast', 'corrupted_real', 'corrupted_forecast'][CAST(floor({uniform_sql(0, "'category'", '{0}')} * 3) AS INTEGER) + 1]"""
_EPOCH_SQL = f"""WITH f AS ({_FAKE_SQL}), r AS ({_REAL_SQL}), z AS (SELECT (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM r) AS nr),
  s AS (SELECT unnest(range(greatest(nf, nr))) AS sub, nf, nr, greatest(nf, nr) AS k FROM z)
  SELECT sub AS slot, 1 AS label, 'real' AS category, sub % nr AS idx FROM s
  UNION ALL SELECT sub + k, 0, {{0}}, CASE WHEN {{0}} = 'corrupted_real' THEN sub % nr ELSE sub % nf END FROM s"""


@query("slot:i label:i category:s idx:i", _EPOCH_SQL.format(_CATEGORY.format("sub")))
def balanced_epoch(v: Views):
    return _epoch(v, augment=True)


@query(
    "slot:i label:i category:s source:s init_time:t lead_hours:i variable:s n:i mean:d",
    f"""WITH e AS ({_EPOCH_SQL.format(_CATEGORY.format("sub"))}),
        s AS (SELECT true AS rl, idx, 'N' AS source, init_time, 0 AS lead_hours FROM ({_REAL_SQL}) UNION ALL SELECT false, idx, source, init_time, lead_hours FROM ({_FAKE_SQL})),
        m AS (SELECT source, init_time, lead_hours, variable, count(*) AS n, avg((value - mean) / std) AS mean FROM v_grid JOIN v_stats USING (variable) GROUP BY 1, 2, 3, 4)
        SELECT slot, label, category, source, init_time, lead_hours, variable, n, mean FROM e
        JOIN s ON s.idx = e.idx AND s.rl = (category IN ('real', 'corrupted_real')) JOIN m USING (source, init_time, lead_hours)""",
)
def epoch_fields(v: Views):
    """The balanced epoch carried out: every slot with the normalized fields of its sample, shown as their means."""
    real = stored(assemble.fake_index(v.stored_grid.where((F.col("source") == "N") & (F.col("lead_hours") == 0)), [0]))
    fake = stored(assemble.fake_index(v.stored_grid.where(F.col("source") != "N"), FORECAST_LEADS))
    epoch = assemble.balanced_epoch(v.spark, real.count(), fake.count(), augment=True)
    z = stats.normalize(v.stored_grid, stats.field_stats(v.stored_grid))
    fields = z.groupBy("source", "init_time", "lead_hours", "variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return assemble.with_fields(assemble.epoch_samples(epoch, real, fake), fields)


@query("label:i category:s n:i", f"SELECT label, category, count(*) AS n FROM ({_EPOCH_SQL.format(repr('forecast'))}) GROUP BY 1, 2")
def epoch_composition(v: Views):
    return assemble.epoch_composition(_epoch(v, augment=False))


@query("event_id:i category:s", f"SELECT event_id, {_CATEGORY.format('event_id')} AS category FROM events")
def fake_category(v: Views):
    return v.table("events").select("event_id", assemble.fake_category(F.col("event_id")).alias("category"))


@query(
    "slot:i label:i corrupted:s",
    f"""WITH e AS (SELECT idx AS slot, 1 AS label FROM ({_REAL_SQL})
          UNION ALL SELECT idx + (SELECT count(*) FROM ({_REAL_SQL})), 0 FROM ({_FAKE_SQL})),
        c AS (SELECT *, {uniform_sql(0, "'augment'", 'slot')} < 0.4 AS hit FROM e)
        SELECT slot, CASE WHEN hit THEN 0 ELSE label END AS label, CASE WHEN hit THEN 'true' ELSE 'false' END AS corrupted FROM c""",
)
def eval_set(v: Views):
    real = materialize(assemble.fake_index(_real_cells(v), [0]))
    return assemble.eval_set(real, assemble.fake_index(_fake_cells(v), FORECAST_LEADS), augment_prob=0.4)


@query(
    "source:s init_time:t lead_hours:i variable:s n:i mean:d",
    """SELECT source, init_time, lead_hours, variable, count(*) AS n, avg((value - mean) / std) AS mean FROM v_grid JOIN v_stats USING (variable)
       WHERE source <> 'N' GROUP BY 1, 2, 3, 4""",
)
def inference_set(v: Views):
    """Every (time, lead) of the forecasts, normalized; shown as the mean of each field."""
    z = stats.normalize(v.grid.where(F.col("source") != "N"), stats.field_stats(v.grid))
    return z.groupBy("source", "init_time", "lead_hours", "variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query(
    "sample_id:i critic:s source:s lead_hours:i label:i logit:d",
    "SELECT l.sample_id, l.critic, s.source, s.lead_hours, s.label, l.logit FROM v_logit l JOIN v_vec s USING (sample_id)",
)
def sample_metadata(v: Views):
    return assemble.sample_metadata(v.logit.select("sample_id", "critic", "logit"), v.vec.drop("vec"))


# --- masks --------------------------------------------------------------------------------------------------------------------

ROWS, COLS = 8, 16


def _batches(v: Views):
    return v.vec.select(F.floor(F.col("sample_id") / 16).alias("batch"), "sample_id")


def _size_sql(purpose: str, scale, aspect) -> str:
    u = uniform_sql(0, f"'{purpose}'", "batch")
    return f"""SELECT batch, least(greatest(1, round_even(sqrt(keep * ratio), 0)), {ROWS - 1}) AS h,
        least(greatest(1, round_even(sqrt(keep / ratio), 0)), {COLS - 1}) AS w FROM (
        SELECT batch, greatest(1, floor({ROWS * COLS} * ({scale[0]} + {u} * ({scale[1] - scale[0]})))) AS keep,
          {aspect[0]} + {u} * ({aspect[1] - aspect[0]}) AS ratio FROM (SELECT DISTINCT vec_id // 16 AS batch FROM embeddings))"""


def _corner_sql(*key) -> str:
    return f"""CAST(floor({uniform_sql(0, *key, "'top'", 'a')} * ({ROWS} - h + 1)) AS INTEGER) AS top,
        CAST(floor({uniform_sql(0, *key, "'left'", 'a')} * ({COLS} - w + 1)) AS INTEGER) AS lft"""


_TARGET_SIZE = _size_sql("target", (0.15, 0.2), (0.75, 1.5))
_TARGET_SQL = f"""SELECT batch, sample_id, block, p AS patch FROM (
    SELECT *, {_corner_sql("'target'", 'batch', 'sample_id', 'block')} FROM (
      SELECT batch, vec_id AS sample_id, block, 1 AS a, h, w FROM embeddings JOIN ({_TARGET_SIZE}) s ON s.batch = vec_id // 16, range(4) AS b(block))),
    range({ROWS * COLS}) AS q(p) WHERE p // {COLS} >= top AND p // {COLS} < top + h AND p % {COLS} >= lft AND p % {COLS} < lft + w"""


@query("batch:i block_h:i block_w:i", f"SELECT batch, h AS block_h, w AS block_w FROM ({_TARGET_SIZE})")
def mask_block_size(v: Views):
    return masks.batch_block_sizes(_batches(v), ROWS, COLS, (0.15, 0.2), (0.75, 1.5))


@query("batch:i sample_id:i block:i patch:i", _TARGET_SQL)
def mask_targets(v: Views):
    found = masks.target_masks(_batches(v), ROWS, COLS)
    return found.select("batch", "sample_id", F.posexplode("targets").alias("block", "t")).select("*", F.explode("t").alias("patch"))


def _disjoint_sql() -> str:
    """Blocks one after the other: the first of 20 attempts that keeps more than 4 patches clear of earlier blocks, else a free one."""
    inside = f"p // {COLS} >= top AND p // {COLS} < top + h AND p % {COLS} >= lft AND p % {COLS} < lft + w"
    parts = [f"s AS (SELECT z.batch, vec_id AS sample_id, h, w FROM embeddings JOIN ({_TARGET_SIZE}) z ON z.batch = vec_id // 16)"]
    for t in range(4):
        tries = "range(1, 22)" if t else "[1]"
        parts.append(
            f"""r{t} AS (SELECT batch, sample_id, a, p FROM (SELECT *, {_corner_sql("'target'", 'batch', 'sample_id', 'block')} FROM (
              SELECT *, unnest({tries}) AS a, {t} AS block FROM s)), range({ROWS * COLS}) AS q(p) WHERE {inside})"""
        )
        taken = " OR ".join(f"EXISTS (SELECT 1 FROM f{e} y WHERE y.sample_id = x.sample_id AND y.p = x.p)" for e in range(t)) or "false"
        parts.append(f"c{t} AS (SELECT * FROM r{t} x WHERE a = 21 OR NOT ({taken}))")
        parts.append(f"m{t} AS (SELECT sample_id, min(a) AS a FROM (SELECT sample_id, a FROM c{t} GROUP BY 1, 2 HAVING count(*) > 4) GROUP BY 1)")
        parts.append(f"f{t} AS (SELECT sample_id, p FROM r{t} JOIN m{t} USING (sample_id, a))")
    kept = " UNION ALL ".join(f"SELECT batch, sample_id, {t} AS block, p FROM c{t} JOIN m{t} USING (sample_id, a)" for t in range(4))
    parts.append(f"k AS ({kept})")
    return f"""WITH {", ".join(parts)}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, block ORDER BY p) AS r,
        count(*) OVER (PARTITION BY sample_id, block) AS n FROM k)
      SELECT batch, sample_id, block, p AS patch FROM (SELECT *, min(n) OVER (PARTITION BY batch) AS cut FROM o) WHERE r <= cut"""


@query("batch:i sample_id:i block:i patch:i", _disjoint_sql())
def mask_targets_disjoint(v: Views):
    found = masks.target_masks(_batches(v), ROWS, COLS, disjoint=True)
    return found.select("batch", "sample_id", F.posexplode("targets").alias("block", "t")).select("*", F.explode("t").alias("patch"))


@query(
    "batch:i sample_id:i patch:i",
    f"""WITH t AS (SELECT sample_id, patch, min(block) AS first_block FROM ({_TARGET_SQL}) GROUP BY 1, 2),
        e AS (SELECT *, CASE WHEN a > 80 THEN 0 ELSE 4 - (a - 1) // 20 END AS avoid, {_corner_sql("'context'", 'batch', 'sample_id')} FROM (
          SELECT batch, vec_id AS sample_id, a, h, w FROM embeddings JOIN ({_size_sql('context', (0.85, 1.0), (1.0, 1.0))}) s
          ON s.batch = vec_id // 16, range(1, 82) AS r(a))),
        k AS (SELECT e.batch, e.sample_id, a, p FROM e, range({ROWS * COLS}) AS q(p)
          WHERE p // {COLS} >= top AND p // {COLS} < top + h AND p % {COLS} >= lft AND p % {COLS} < lft + w
          AND NOT EXISTS (SELECT 1 FROM t WHERE t.sample_id = e.sample_id AND t.patch = q.p AND t.first_block < e.avoid)),
        c AS (SELECT batch, sample_id, min(a) AS a FROM (SELECT batch, sample_id, a FROM k GROUP BY 1, 2, 3 HAVING count(*) > 4) GROUP BY 1, 2),
        o AS (SELECT k.*, row_number() OVER (PARTITION BY k.sample_id ORDER BY p) AS r, count(*) OVER (PARTITION BY k.sample_id) AS n
              FROM k JOIN c ON c.sample_id = k.sample_id AND c.a = k.a)
        SELECT batch, sample_id, p AS patch FROM (SELECT *, min(n) OVER (PARTITION BY batch) AS cut FROM o) WHERE r <= cut""",
)
def mask_context(v: Views):
    found = masks.context_masks(masks.target_masks(_batches(v), ROWS, COLS), ROWS, COLS)
    return found.select("batch", "sample_id", F.explode("context").alias("patch"))


@query(
    "batch:i sample_id:i block:i patch:i",
    f"""WITH t AS (SELECT sample_id, patch, min(block) AS first_block FROM ({_TARGET_SQL}) GROUP BY 1, 2),
        e AS (SELECT *, CASE WHEN a > 80 THEN 0 ELSE 4 - (a - 1) // 20 END AS avoid, {_corner_sql("'contexts'", 'batch', 'sample_id', 'block')} FROM (
          SELECT batch, vec_id AS sample_id, block, a, h, w FROM embeddings JOIN ({_size_sql('contexts', (0.85, 1.0), (1.0, 1.0))}) s
          ON s.batch = vec_id // 16, range(1, 82) AS r(a), range(3) AS b(block))),
        k AS (SELECT e.batch, e.sample_id, block, a, p FROM e, range({ROWS * COLS}) AS q(p)
          WHERE p // {COLS} >= top AND p // {COLS} < top + h AND p % {COLS} >= lft AND p % {COLS} < lft + w
          AND NOT EXISTS (SELECT 1 FROM t WHERE t.sample_id = e.sample_id AND t.patch = q.p AND t.first_block < e.avoid)),
        c AS (SELECT sample_id, block, min(a) AS a FROM (SELECT sample_id, block, a FROM k GROUP BY 1, 2, 3 HAVING count(*) > 4) GROUP BY 1, 2),
        o AS (SELECT k.*, row_number() OVER w AS r, count(*) OVER (PARTITION BY k.sample_id, k.block) AS n
              FROM k JOIN c ON c.sample_id = k.sample_id AND c.block = k.block AND c.a = k.a WINDOW w AS (PARTITION BY k.sample_id, k.block ORDER BY p))
        SELECT batch, sample_id, block, p AS patch FROM (SELECT *, min(n) OVER (PARTITION BY batch) AS cut FROM o) WHERE r <= cut""",
)
def mask_contexts(v: Views):
    """Three context blocks per sample."""
    found = masks.context_blocks(masks.target_masks(_batches(v), ROWS, COLS), ROWS, COLS, 3)
    return found.select("batch", "sample_id", F.posexplode("contexts").alias("block", "c")).select("batch", "sample_id", "block", F.explode("c").alias("patch"))


@query(
    "batch:i sample_id:i patch:i",
    f"""WITH b AS (SELECT vec_id // 16 AS batch, vec_id AS sample_id FROM embeddings),
        s AS (SELECT *, greatest(1, least({COLS}, round_even((0.85 + {uniform_sql(0, "'band'", 'batch')} * ({1.0 - 0.85})) * {COLS}, 0))) AS band,
          CAST(floor({uniform_sql(0, "'start'", 'batch', 'sample_id')} * {COLS}) AS INTEGER) AS start FROM b),
        k AS (SELECT s.batch, s.sample_id, p FROM s, range({ROWS * COLS}) AS q(p) WHERE ((p % {COLS} - start) % {COLS} + {COLS}) % {COLS} < band
          AND NOT EXISTS (SELECT 1 FROM ({_TARGET_SQL}) t WHERE t.sample_id = s.sample_id AND t.patch = q.p)),
        o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM k)
        SELECT batch, sample_id, p AS patch FROM (SELECT *, min(n) OVER (PARTITION BY batch) AS cut FROM o) WHERE r <= cut""",
)
def mask_world_band(v: Views):
    found = masks.world_band_masks(masks.target_masks(_batches(v), ROWS, COLS), ROWS, COLS)
    return found.select("batch", "sample_id", F.explode("context").alias("patch"))


@query(
    "sample_id:i patch:i hidden:i",
    f"""SELECT vec_id AS sample_id, p AS patch, EXISTS (SELECT 1 FROM ({_TARGET_SQL}) t WHERE t.sample_id = vec_id AND t.patch = q.p) AS hidden
        FROM embeddings, range({ROWS * COLS}) AS q(p)""",
)
def mask_visible(v: Views):
    found = masks.visible_masks(masks.target_masks(_batches(v), ROWS, COLS), ROWS * COLS, strict=False)
    part = lambda name, flag: F.transform(name, lambda p: F.struct(p.alias("patch"), F.lit(flag).alias("hidden")))
    both = F.concat(part("visible", 0), part("masked", 1))
    return found.select("sample_id", F.explode(both).alias("e")).select("sample_id", "e.patch", "e.hidden")


def _rank_sql(n: int) -> str:
    return f"""SELECT sample_id, p AS patch, row_number() OVER (PARTITION BY sample_id ORDER BY {digest_sql(0, "'mask'", 'sample_id', 'p')}) - 1 AS r
        FROM v_vec, range({n}) AS q(p)"""


@query("sample_id:i patch:i restore:i masked:i", f"SELECT sample_id, patch, r AS restore, CASE WHEN r < 16 THEN 0 ELSE 1 END AS masked FROM ({_rank_sql(64)})")
def random_mask(v: Views):
    found = masks.random_mask(v.vec.select("sample_id"), 64, 0.75)
    flags = F.arrays_zip(F.col("restore").alias("r"), F.col("mask").alias("m"))
    return found.select("sample_id", F.posexplode(flags).alias("patch", "e")).select("sample_id", "patch", F.col("e.r").alias("restore"), F.col("e.m").alias("masked"))


_TOKEN_SQL = """SELECT sample_id, source, (y // 2) * 2 + x // 2 AS patch, (list_position(['t', 'u', 'v', 'p'], variable) - 1) * 4 + (y % 2) * 2 + x % 2 AS d,
  value FROM v_cell4"""


def _kept(v: Views):
    found = masks.random_mask(v.vec.select("sample_id"), 4, 0.5)
    return found.select("sample_id", F.posexplode("keep").alias("place", "patch"))


@query(
    "sample_id:i place:i patch:i d:i value:d",
    f"SELECT t.sample_id, r AS place, t.patch, d, value FROM ({_TOKEN_SQL}) t JOIN ({_rank_sql(4)}) k ON k.sample_id = t.sample_id AND k.patch = t.patch WHERE r < 2",
)
def gather_masked(v: Views):
    kept = masks.gather(compose.patchify(v.snap4, 2, CHANNELS), _kept(v))
    return kept.select("sample_id", "place", "patch", F.posexplode("token").alias("d", "value"))


# --- tokens and features ------------------------------------------------------------------------------------------------------


def _pooled(v: Views, kind: str):
    pooled = tokens.pool_tokens(compose.patchify(v.snap4, 2, CHANNELS), kind)
    return pooled.select("sample_id", F.posexplode("vec").alias("d", "value"))


@query("sample_id:i d:i value:d", f"SELECT sample_id, d, avg(value) AS value FROM ({_TOKEN_SQL}) GROUP BY 1, 2")
def pool_mean(v: Views):
    return _pooled(v, "mean")


@query("sample_id:i d:i value:d", f"SELECT sample_id, d, max(value) AS value FROM ({_TOKEN_SQL}) GROUP BY 1, 2")
def pool_max(v: Views):
    return _pooled(v, "max")


@query(
    "sample_id:i d:i value:d",
    f"""SELECT sample_id, d, avg(value) AS value FROM ({_TOKEN_SQL}) GROUP BY 1, 2
        UNION ALL SELECT sample_id, d + 16, max(value) FROM ({_TOKEN_SQL}) GROUP BY 1, 2""",
)
def pool_concat(v: Views):
    return _pooled(v, "concat")


BASIS = [[2.0 * uniform_value("basis", k, d) - 1.0 for d in range(16)] for k in range(3)]


@query(
    "sample_id:i d:i value:d",
    f"""SELECT sample_id, k AS d, avg(dot) AS value FROM (
          SELECT sample_id, patch, k, sum(value * {BASIS}[k + 1][CAST(d AS INTEGER) + 1]) AS dot FROM ({_TOKEN_SQL}), range(3) AS b(k) GROUP BY 1, 2, 3)
        GROUP BY 1, 2""",
)
def extract_features(v: Views):
    found = tokens.extract_features(v.snap4, 2, CHANNELS, BASIS)
    return found.select("sample_id", F.posexplode("vec").alias("d", "value"))


@query(
    "masked_l1:d n:i",
    f"""SELECT avg(l) AS masked_l1, count(*) AS n FROM (SELECT t.sample_id, t.patch, avg(abs(value - (value * 0.5 + 0.01))) AS l FROM ({_TOKEN_SQL}) t
        JOIN ({_rank_sql(4)}) k ON k.sample_id = t.sample_id AND k.patch = t.patch WHERE r >= 2 GROUP BY 1, 2)""",
)
def masked_l1(v: Views):
    truth = compose.patchify(v.snap4, 2, CHANNELS)
    guess = truth.withColumn("token", F.transform("token", lambda x: x * 0.5 + 0.01))
    found = masks.random_mask(v.vec.select("sample_id"), 4, 0.5).select("sample_id", F.posexplode("mask").alias("patch", "m"))
    return tokens.masked_l1(truth, guess, found.where(F.col("m") == 1))


@query(
    "event_type:s loss:d",
    """SELECT event_type, avg(CASE WHEN abs(value - 20) < 1 THEN 0.5 * (value - 20) * (value - 20) ELSE abs(value - 20) - 0.5 END) AS loss
       FROM events GROUP BY 1""",
)
def smooth_l1(v: Views):
    return v.table("events").groupBy("event_type").agg(F.avg(tokens.smooth_l1(F.col("value"), F.lit(20.0))).alias("loss"))


@query("model:s spread:d", "SELECT model, stddev_samp(value) AS spread FROM v_dims GROUP BY 1")
def latent_spread(v: Views):
    return tokens.latent_spread(v.vec, ["model"])


# --- catalog ------------------------------------------------------------------------------------------------------------------

_ALIAS_CASE = "CASE " + " ".join(f"WHEN token LIKE '%{a}%' THEN '{n}'" for a, n in catalog.MODEL_ALIASES.items())
_TITLE = "array_to_string(list_transform(regexp_extract_all(translate(stem, '_-', '  '), '[A-Za-z]+|[^A-Za-z]+'), lambda s: upper(s[1]) || lower(s[2:])), '')"
_PARSED_SQL = f"""SELECT path, token, {_ALIAS_CASE} ELSE {_TITLE} END AS label,
    nullif(regexp_extract(path, '_(\\d{{4}}-\\d{{2}}-\\d{{2}})_(\\d{{4}}-\\d{{2}}-\\d{{2}})\\.nc$', 1), '') AS "start",
    nullif(regexp_extract(path, '_(\\d{{4}}-\\d{{2}}-\\d{{2}})_(\\d{{4}}-\\d{{2}}-\\d{{2}})\\.nc$', 2), '') AS "end"
  FROM (SELECT path, stem, lower(replace(replace(replace(stem, '-', ''), '_', ''), ' ', '')) AS token FROM (
    SELECT path, split_part(split_part(path, '/', -1), '_6steps', 1) AS stem FROM v_files))"""
_NEURAL_SQL = f"SELECT path, label FROM ({_PARSED_SQL}) WHERE label NOT IN ('IFS HRES', 'ERA5 Forecast')"
_POOLS_SQL = f"""SELECT h.holdout, n.path, n.label FROM ({_NEURAL_SQL}) n,
    (SELECT DISTINCT label AS holdout FROM ({_NEURAL_SQL}) UNION ALL SELECT 'full_pool') h WHERE h.holdout <> n.label"""


@query("path:s token:s start:s end:s", f"SELECT * FROM ({_PARSED_SQL})")
def parse_filename(v: Views):
    token = catalog.name_token(F.split(catalog.base_name(F.col("path")), "_6steps").getItem(0))
    return catalog.parse_files(v.files).withColumn("token", token)


@query("label:s n:i", f"SELECT label, count(*) AS n FROM ({_PARSED_SQL}) GROUP BY 1")
def model_label(v: Views):
    return v.files.groupBy(catalog.model_label(F.col("path")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("label:s safe:s", f"SELECT DISTINCT label, replace(replace(label, ' ', '_'), '/', '_') AS safe FROM ({_PARSED_SQL})")
def safe_name(v: Views):
    return catalog.parse_files(v.files).select("label", catalog.safe_name(F.col("label")).alias("safe")).distinct()


_CHECKPOINT_SQL = f"""SELECT DISTINCT CASE CAST("start"[:4] AS INTEGER) % 3 WHEN 0 THEN 'critic_exclude_' || replace(label, ' ', '_') || '.pth'
    WHEN 1 THEN 'critic_' || "start"[:4] || '_full_pool.pth' ELSE 'critic_' || "start"[:4] || '.pth' END AS name FROM ({_PARSED_SQL})"""


@query(
    "name:s label:s",
    f"""SELECT name, CASE WHEN name LIKE '%\\_exclude\\_%' ESCAPE '\\' THEN CASE WHEN l NOT IN ('IFS HRES', 'ERA5 Forecast') THEN 'Excl: ' || l END
          WHEN name LIKE '%\\_full\\_pool%' ESCAPE '\\' THEN 'Full AI Pool' END AS label
        FROM (SELECT name, replace(replace(split_part(name, '_exclude_', 2), '.pth', ''), '_', ' ') AS l FROM ({_CHECKPOINT_SQL}))""",
)
def fold_label(v: Views):
    year = F.substring("start", 1, 4)
    name = (
        F.when(year.cast("int") % 3 == 0, F.concat(F.lit("critic_exclude_"), catalog.safe_name(F.col("label")), F.lit(".pth")))
        .when(year.cast("int") % 3 == 1, F.concat(F.lit("critic_"), year, F.lit("_full_pool.pth")))
        .otherwise(F.concat(F.lit("critic_"), year, F.lit(".pth")))
    )
    names = catalog.parse_files(v.files).select(name.alias("name")).distinct()
    return names.withColumn("label", catalog.fold_label(F.col("name")))


@query(
    "label:s train:s test:s",
    f"""SELECT label, max(path) FILTER ("start"[:4] = '1996') AS train, max(path) FILTER ("start"[:4] = '1998') AS test FROM ({_PARSED_SQL})
        GROUP BY 1 HAVING train IS NOT NULL AND test IS NOT NULL""",
)
def temporal_pairs(v: Views):
    return catalog.temporal_pairs(v.files, "1996", "1998")


@query("holdout:s path:s label:s", _POOLS_SQL)
def kfold_pools(v: Views):
    return catalog.kfold_pools(v.files)


@query(
    "holdout:s n_files:i trained_as:s",
    f"""WITH p AS (SELECT holdout, path FROM ({_POOLS_SQL})
          UNION ALL SELECT 'second run', path FROM ({_POOLS_SQL}) WHERE holdout = 'Keisler'),
        l AS (SELECT holdout, list(DISTINCT path ORDER BY path) AS files FROM p GROUP BY 1)
        SELECT holdout, len(files) AS n_files, min(holdout) OVER (PARTITION BY files) AS trained_as FROM l""",
)
def pool_dedup(v: Views):
    pools = catalog.kfold_pools(v.files).select("holdout", "path")
    again = pools.where(F.col("holdout") == "Keisler").withColumn("holdout", F.lit("second run"))
    return catalog.pool_dedup(pools.unionByName(again))


# --- critics ------------------------------------------------------------------------------------------------------------------


@query("sample_id:i critic:s logit:d", "SELECT sample_id, critic, logit FROM v_logit")
def critic_score(v: Views):
    return v.logit


@query("label:i lead_hours:i mean_logit:d std_logit:d n:i")
def critic_fit(v: Views):
    """Critic fitted on the train half of the vectors, scored on the other half."""
    halves = select.split_halves(v.vec, "sample_id", seed=1)
    weights = critic.fit_critic(halves.where(F.col("half") == "a"), reg=0.01)
    scored = critic.score_critic(halves.where(F.col("half") == "b"), {"fitted": weights})
    return scores.logit_curve(scored, ["label", "lead_hours"])


@query("critic:s source:s lead_hours:i mean_logit:d std_logit:d n:i")
def kfold_critics(v: Views):
    """One critic per left-out model and one of the full pool, fitted together; a fold's critic is scored on the reference and on the model
    it never saw, the full pool's on everything.
    """
    vecs = v.vec.withColumn("model", F.when(F.col("label") == 0, F.col("model")))
    fitted = critic.fit_folds(critic.left_out_folds(vecs))
    mine = lambda fold: (F.col("label") == 1) | (fold == F.col("model")) | (fold == catalog.FULL_POOL)
    return scores.logit_curve(critic.score_folds(vecs, fitted, mine), ["critic", "source", "lead_hours"])


@query(
    "fold:s i:i gradient:d n:i",
    """WITH m AS (SELECT DISTINCT model AS fold FROM v_vec WHERE label = 0 UNION ALL SELECT 'full_pool')
       SELECT fold, i, avg((0.5 - label) * value) AS gradient, count(*) AS n FROM v_dims JOIN m ON label = 1 OR model <> fold GROUP BY 1, 2""",
)
def kfold_gradients(v: Views):
    """The gradient of every fold's loss where the fit begins, at weights 0."""
    vecs = v.vec.withColumn("model", F.when(F.col("label") == 0, F.col("model")))
    rows = critic.left_out_folds(vecs).select(F.explode("folds").alias("fold"), "label", "vec")
    parts = rows.select("fold", F.posexplode("vec").alias("i", "x"), "label")
    return parts.groupBy("fold", "i").agg(F.avg((0.5 - F.col("label")) * F.col("x")).alias("gradient"), F.count("*").alias("n"))


_RANGE_OF = " ".join(f"WHEN {' AND '.join(c for c in (lo and f'init_time >= TIMESTAMP {lo!r}', hi and f'init_time < TIMESTAMP {hi!r} + INTERVAL 1 DAY') if c)} THEN {i}" for i, (lo, hi) in enumerate(TEST))


@query(
    "source:s test_range:i n_train:i n_test:i",
    f"""WITH t AS (SELECT DISTINCT source, init_time FROM v_grid),
        a AS (SELECT source, count(*) AS n_train FROM t, {ranges_sql(TRAIN)} WHERE {in_range_sql()} GROUP BY 1),
        b AS (SELECT source, CASE {_RANGE_OF} END AS test_range, count(*) AS n_test FROM t WHERE CASE {_RANGE_OF} END IS NOT NULL GROUP BY 1, 2)
        SELECT source, test_range, n_train, n_test FROM a JOIN b USING (source)""",
)
def holdout_pairs(v: Views):
    return catalog.holdout_pairs(v.grid.select("source", "init_time"), TRAIN, TEST)


@query("critic:s test_range:i source:s lead_hours:i mean_logit:d std_logit:d n:i")
def temporal_holdout(v: Views):
    """Per forecast source that has train and test times: a critic on snapshot features of the train ranges, all fitted together, and its
    scores per test range and lead, on that source and on the reference.
    """
    z = stats.normalize(v.stored_grid, stats.train_stats(v.stored_grid, TRAIN, VARIABLES))
    means = [F.avg(F.when(F.col("variable") == name, F.col("value"))) for name in VARIABLES]
    snapshots = z.groupBy("source", "init_time", "lead_hours").agg(F.array(*[F.coalesce(m, F.lit(0.0)) for m in means]).alias("vec"))
    snapshots = stored(snapshots.withColumn("label", (F.col("source") == "N").cast("int")))
    pairs = stored(catalog.holdout_pairs(snapshots.select("source", "init_time"), TRAIN, TEST))
    named = pairs.where("source <> 'N'").agg(F.sort_array(F.collect_set("source"))).scalar()  # the few forecast sources
    mine = F.when(F.col("label") == 1, F.col("_m")).otherwise(F.array_intersect("_m", F.array("source")))
    train = snapshots.where(select.in_ranges(TRAIN, F.col("init_time"))).withColumn("_m", named).withColumn("folds", mine)
    fitted = critic.fit_folds(train.drop("_m"))
    tests = [snapshots.where(select.in_ranges([r], F.col("init_time"))).withColumn("test_range", F.lit(i)) for i, r in enumerate(TEST)]
    test = tests[0].unionByName(tests[1]).unionByName(tests[2]).join(pairs.select("source", "test_range"), ["source", "test_range"], "left_semi")
    scored = critic.score_folds(test, fitted, lambda fold: (F.col("label") == 1) | (fold == F.col("source")))
    return scores.logit_curve(scored, ["critic", "test_range", "source", "lead_hours"])


@query(
    "critic:s source:s lead_hours:i mean_logit:d std_logit:d n:i",
    """SELECT 'm' || (5 + CAST(critic[2:] AS INTEGER)) AS critic, source, lead_hours, avg(logit) AS mean_logit, stddev_pop(logit) AS std_logit,
         count(*) AS n FROM v_logit WHERE label = 1 OR model = 'm' || (5 + CAST(critic[2:] AS INTEGER)) GROUP BY 1, 2, 3""",
)
def kfold_lead_curves(v: Views):
    critics = {f"m{5 + c}": (critic.keyed_weights(c, 64), 0.0) for c in range(3)}
    return scores.logit_curve(critic.own_holdout_scores(v.vec, critics), ["critic", "source", "lead_hours"])


@query(
    "critic:s model:s lead_hours:i mean_logit:d std_logit:d n:i ref_mean:d ref_std:d base_mean:d base_std:d",
    """WITH l AS (SELECT *, CASE critic WHEN 'c0' THEN 'm5' WHEN 'c1' THEN 'm6' END AS holdout FROM v_logit)
       SELECT a.*, ref_mean, ref_std, base_mean, base_std FROM
         (SELECT critic, model, lead_hours, avg(logit) AS mean_logit, stddev_pop(logit) AS std_logit, count(*) AS n FROM l
          WHERE label = 0 AND model <> 'm9' AND (holdout IS NULL OR holdout = model) GROUP BY 1, 2, 3) a
         LEFT JOIN (SELECT critic AS c, avg(logit) AS ref_mean, stddev_pop(logit) AS ref_std FROM l WHERE label = 1 GROUP BY 1) r ON r.c = a.critic
         LEFT JOIN (SELECT critic AS c, lead_hours AS h, avg(logit) AS base_mean, stddev_pop(logit) AS base_std FROM l
                    WHERE label = 0 AND model = 'm9' GROUP BY 1, 2) b ON b.c = a.critic AND b.h = a.lead_hours""",
)
def kfold_evaluation(v: Views):
    """Two folds and the full pool (the last critic), with reference band and numerical baseline beside each curve."""
    holdout = F.when(F.col("critic") == "c0", "m5").when(F.col("critic") == "c1", "m6")
    return scores.kfold_evaluation(v.logit.withColumn("holdout", holdout), "holdout", baseline=["m9"])
