"""Curves and scores from critic logits: rows (sample_id, source, lead_hours, critic, label, logit)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXP_LIMIT = 50.0  # fixed value: bound of the exponent in the reverse-KL critic


def logit_curve(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of logits per group."""
    return df.groupBy(*by).agg(
        F.avg("logit").alias("mean_logit"), F.stddev_pop("logit").alias("std_logit"), F.count("logit").alias("n")
    )


def reference_band(reference: DataFrame) -> DataFrame:
    """One row: the mean over critics of each critic's mean and of its standard deviation."""
    return logit_curve(reference, ["critic"]).agg(
        F.avg("mean_logit").alias("band_mean"), F.avg("std_logit").alias("band_std"), F.count(F.lit(1)).alias("n_critics")
    )


def baseline_curve(own: DataFrame, baseline: DataFrame) -> DataFrame:
    """Own curve per (critic, lead) beside the baseline source's curve for the same critic and lead (null when absent)."""
    a = logit_curve(own, ["critic", "lead_hours"]).drop("n")
    b = logit_curve(baseline, ["critic", "lead_hours"]).select(
        "critic", "lead_hours", F.col("mean_logit").alias("base_mean"), F.col("std_logit").alias("base_std")
    )
    return a.join(b, ["critic", "lead_hours"], "left")


def kfold_evaluation(scored: DataFrame, holdout: str, skip: Sequence[str] = (), baseline: Sequence[str] = ()) -> DataFrame:
    """Lead curves of every critic on the model it never saw, beside the critic's reference band and its curve of the numerical baseline.

    scored(critic, model, label, lead_hours, logit); `holdout` names the column with a critic's left-out model, null for the full pool,
    whose curve has every model. Critics in `skip` are left out. Baseline columns are null where the baseline lacks a lead.
    """
    rows = scored.where(~F.col("critic").isin(list(skip)))
    numeric = F.col("model").isin(list(baseline))
    fakes = rows.where((F.col("label") == 0) & ~numeric)
    own = logit_curve(fakes.where(F.col(holdout).isNull() | (F.col(holdout) == F.col("model"))), ["critic", "model", "lead_hours"])
    real = logit_curve(rows.where(F.col("label") == 1), ["critic"]).select("critic", F.col("mean_logit").alias("ref_mean"), F.col("std_logit").alias("ref_std"))
    base = logit_curve(rows.where((F.col("label") == 0) & numeric), ["critic", "lead_hours"]).select(
        "critic", "lead_hours", F.col("mean_logit").alias("base_mean"), F.col("std_logit").alias("base_std")
    )
    return own.join(real, "critic", "left").join(base, ["critic", "lead_hours"], "left")


def mean_stderr(v: Column) -> Column:
    """struct(mean, stderr, n); the standard error uses ddof 1 and is 0 for one value."""
    stderr = F.coalesce(F.try_divide(F.stddev_samp(v), F.sqrt(F.count(v).cast("double"))), F.lit(0.0))
    return F.struct(F.avg(v).alias("mean"), stderr.alias("stderr"), F.count(v).alias("n"))


def expectation(df: DataFrame, by: Sequence[str], transform: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """Mean and standard error of a transformed logit per group."""
    return df.groupBy(*by).agg(mean_stderr(transform(F.col("logit"))).alias("_e")).select(*by, "_e.*")


def reverse_kl_critic(v: Column) -> Column:
    return -F.exp(F.least(-v, F.lit(EXP_LIMIT)))


def reverse_kl_conjugate(v: Column) -> Column:
    return v - 1.0


def reverse_kl(reference: DataFrame, candidates: DataFrame, by: Sequence[str], real_by: Sequence[str] = ()) -> DataFrame:
    """S(Q) = E_X[T] - E_Q[f*(T)] per candidate group, with the standard error in quadrature.

    The reference term is one row, read as a scalar subquery, or one row for each value of `real_by` (among `by`, such as the critic). A
    group without reference samples is an error.
    """
    fake = expectation(candidates, by, reverse_kl_conjugate)
    if real_by:
        real = reference.groupBy(*real_by).agg(mean_stderr(reverse_kl_critic(F.col("logit"))).alias("_r"))
        fake = fake.join(real, list(real_by), "left")
    else:
        fake = fake.withColumn("_r", reference.agg(mean_stderr(reverse_kl_critic(F.col("logit"))).alias("e")).scalar())
    real_mean = F.when(F.col("_r.n") > 0, F.col("_r.mean")).otherwise(F.raise_error(F.lit("no reference samples")).cast("double"))
    spread = F.sqrt(F.col("_r.stderr") * F.col("_r.stderr") + F.col("stderr") * F.col("stderr"))
    return fake.select(*by, (real_mean - F.col("mean")).alias("score"), spread.alias("stderr"), "n")


def bce_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Binary cross-entropy of logits and accuracy at logit > 0."""
    v, y = F.col("logit"), F.col("label")
    loss = F.greatest(v, F.lit(0.0)) - v * y + F.log1p(F.exp(-F.abs(v)))
    right = F.when((v > 0).cast("int") == y, 1.0).otherwise(0.0)
    aggs = [F.avg(loss).alias("loss"), F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(*by).agg(*aggs)


def sigmoid_realism(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(1 / (1 + F.exp(-F.col("logit")))).alias("realism"), F.count("logit").alias("n"))


def topk_samples(df: DataFrame, k: int = 3) -> DataFrame:
    """The k most real, most uncertain, best fake (label 0, highest) and worst fake (lowest) samples, with their rank.

    Each list is a top-k on every partition and a merge of those, never a full sort.
    """
    fakes = F.col("label") == 0
    lists = [
        ("Realest", F.lit(True), -F.col("logit")),
        ("Most Uncertain", F.lit(True), F.abs("logit")),
        ("Best Fakes", fakes, -F.col("logit")),
        ("Worst Fakes", fakes, F.col("logit")),
    ]
    out = None
    for name, cond, order in lists:
        top = df.where(cond).withColumn("_o", order).orderBy("_o", "sample_id").limit(k)
        packed = top.agg(F.sort_array(F.collect_list(F.struct("_o", "sample_id", F.struct(*df.columns).alias("r")))).alias("l"))
        rows = packed.select(F.posexplode("l").alias("p", "e")).select(F.lit(name).alias("category"), (F.col("p") + 1).alias("rank"), "e.r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def normalize_curve(curve: DataFrame, by: Sequence[str], x: str, value: str) -> DataFrame:
    """(d - d0) / (|d0| + 1e-8) with d0 at the smallest x of each series."""
    start = curve.groupBy(*by).agg(F.min_by(value, x).alias("_d0"))
    rel = (F.col(value) - F.col("_d0")) / (F.abs("_d0") + 1e-8)
    return curve.join(start, list(by)).withColumn("relative", rel).drop("_d0")
