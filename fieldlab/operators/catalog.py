"""File names, model labels, training pools and their de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.operators.select import in_ranges

# Aliases in matching order, and the models that are no machine-learning forecasts.
MODEL_ALIASES = {
    "graphcast": "GraphCast",
    "pangu": "Pangu-Weather",
    "panguweather": "Pangu-Weather",
    "fuxi": "FuXi",
    "keisler": "Keisler",
    "neuralgcm": "NeuralGCM",
    "sphericalcnn": "SphericalCNN",
    "ifshres": "IFS HRES",
    "era5forecast": "ERA5 Forecast",
}
NUMERICAL_MODELS = ("IFS HRES", "ERA5 Forecast")
DATE_SPAN = r"_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.nc$"
FULL_POOL = "full_pool"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def name_token(name: Column) -> Column:
    """Lower case without hyphens, underscores and spaces."""
    return F.translate(F.lower(name), "-_ ", "")


def span_start(path: Column) -> Column:
    """First date of the span in a file name; null without one."""
    return F.nullif(F.regexp_extract(base_name(path), DATE_SPAN, 1), F.lit(""))


def span_end(path: Column) -> Column:
    return F.nullif(F.regexp_extract(base_name(path), DATE_SPAN, 2), F.lit(""))


def model_label(path: Column) -> Column:
    """Display label of a forecast file: the first alias its token contains, else its title-cased stem."""
    stem = F.split(base_name(path), "_6steps").getItem(0)
    token = name_token(stem)
    label = None
    for alias, name in MODEL_ALIASES.items():
        label = F.when(token.contains(alias), name) if label is None else label.when(token.contains(alias), name)
    runs = F.regexp_extract_all(F.translate(stem, "_-", "  "), F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return label.otherwise(F.array_join(F.transform(runs, F.initcap), ""))


def safe_name(name: Column) -> Column:
    return F.translate(name, " /", "__")


def variable_tag(variables: Sequence[str]) -> str:
    return variables[0] if len(variables) == 1 else "all_fields"


def run_tag(*parts: str | None) -> str:
    return "_".join(p for p in parts if p)


def fold_label(checkpoint: Column) -> Column:
    """Label of a fold's checkpoint file; null for files that belong to no fold and for held-out numerical models."""
    name = F.translate(F.replace(F.element_at(F.split(checkpoint, "_exclude_"), 2), F.lit(".pth"), F.lit("")), "_", " ")
    excluded = F.when(~name.isin(list(NUMERICAL_MODELS)), F.concat(F.lit("Excl: "), name))
    return F.when(checkpoint.contains("_exclude_"), excluded).when(checkpoint.contains("_full_pool"), "Full AI Pool")


def parse_files(files: DataFrame, path: str = "path") -> DataFrame:
    p = F.col(path)
    return files.withColumn("label", model_label(p)).withColumn("start", span_start(p)).withColumn("end", span_end(p))


def candidate_files(*sources: DataFrame) -> DataFrame:
    """Distinct sorted paths of configured, comparison and found files."""
    out = sources[0].select("path")
    for s in sources[1:]:
        out = out.unionByName(s.select("path"))
    return out.distinct().orderBy("path")


def temporal_pairs(files: DataFrame, train_year: str, test_year: str) -> DataFrame:
    """(label, train, test) for models that have a file in both years; of several, the last by name."""
    parsed = parse_files(files).withColumn("year", F.substring("start", 1, 4))
    wide = parsed.groupBy("label").agg(
        F.max(F.when(F.col("year") == train_year, F.col("path"))).alias("train"),
        F.max(F.when(F.col("year") == test_year, F.col("path"))).alias("test"),
    )
    return wide.where(F.col("train").isNotNull() & F.col("test").isNotNull())


def kfold_pools(files: DataFrame, holdouts: Sequence[str] | None = None) -> DataFrame:
    """(holdout, path): the training files of each fold, all but the held-out model's; numerical models never train.

    `full_pool` holds out nothing. Folds are the models present unless listed; each file lists its own folds, so nothing is joined.
    """
    neural = parse_files(files).where(~F.col("label").isin(list(NUMERICAL_MODELS)))
    if holdouts is None:
        folds = neural.agg(F.sort_array(F.collect_set("label"))).scalar()
    else:
        folds = F.array(*[F.lit(h) for h in holdouts])
    mine = F.concat(F.array(F.lit(FULL_POOL)), F.array_remove(folds, F.col("label")))
    return neural.select(F.explode(mine).alias("holdout"), "path", "label")


def require_pool(pools: DataFrame, holdout: str) -> DataFrame:
    if pools.where(F.col("holdout") == holdout).isEmpty():
        raise ValueError(f"no training files for fold {holdout}")
    return pools


def pool_dedup(pools: DataFrame) -> DataFrame:
    """(holdout, n_files, trained_as): folds with the same files share the first fold's critic.

    Folds are compared by order-free digests of their files (count, sum and exclusive or of hashes), which are plain aggregates; a fold
    whose digests agree with an earlier one is confirmed file by file, by an anti-join.
    """
    files = pools.select("holdout", "path").distinct()
    h = F.xxhash64("path")
    digest = files.groupBy("holdout").agg(F.count("*").alias("n_files"), F.sum(h.cast("decimal(38, 0)")).alias("_s"), F.bit_xor(h).alias("_x"))
    keys = ["n_files", "_s", "_x"]
    alike = digest.join(digest.groupBy(*keys).agg(F.min("holdout").alias("trained_as")), keys).select("holdout", "n_files", "trained_as")
    shared = alike.where(F.col("holdout") != F.col("trained_as"))
    theirs = files.select(F.col("holdout").alias("trained_as"), "path")
    unlike = files.join(shared, "holdout").join(theirs, ["trained_as", "path"], "left_anti").select("holdout").distinct()
    marked = alike.join(unlike.withColumn("_unlike", F.lit(True)), "holdout", "left")
    return marked.select("holdout", "n_files", F.when(F.col("_unlike"), F.col("holdout")).otherwise(F.col("trained_as")).alias("trained_as"))


def holdout_pairs(times: DataFrame, train: Sequence, test: Sequence) -> DataFrame:
    """(source, test_range, n_train, n_test) of every source with times in the train ranges and in that test range, from times(source,
    init_time). Test ranges are numbered from 0.
    """
    at = F.col("init_time")
    where = F.concat(
        F.when(in_ranges(train, at), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")),
        *[F.when(in_ranges([r], at), F.array(F.lit(i))).otherwise(F.array().cast("array<int>")) for i, r in enumerate(test)],
    )
    counts = times.distinct().select("source", F.explode(where).alias("test_range")).groupBy("source", "test_range").agg(F.count("*").alias("n_test"))
    trained = counts.where("test_range = -1").select("source", F.col("n_test").alias("n_train"))
    return counts.where("test_range >= 0").join(trained, "source").select("source", "test_range", "n_train", "n_test")
