"""Training and evaluation sets as plans: which sample goes where, with which label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions.keyed import uniform
from fieldlab.operators.ranking import position
from fieldlab.operators.select import filter_leads

FAKE_CATEGORIES = ("forecast", "corrupted_real", "corrupted_forecast")


def fake_index(df: DataFrame, leads: Sequence[int] | None = None) -> DataFrame:
    """Distinct (source, init_time, lead_hours) with a flat index `idx` in that order."""
    samples = filter_leads(df, leads).select("source", "init_time", "lead_hours").distinct()
    bucket = F.struct(F.col("source"), F.col("init_time").cast("date"))
    return position(samples, ["source", "init_time", "lead_hours"], bucket, (), "idx")


def count_samples(df: DataFrame, leads: Sequence[int] | None = None) -> int:
    """Number of distinct samples, without an index."""
    return filter_leads(df, leads).select("source", "init_time", "lead_hours").distinct().count()


def fake_category(slot: Column, augment: bool = True, seed: int = 0) -> Column:
    """Category of a fake slot, uniform over three; forecast only without augmentation."""
    if not augment:
        return F.lit("forecast")
    kinds = F.array(*[F.lit(c) for c in FAKE_CATEGORIES])
    return F.get(kinds, F.floor(uniform(seed, "category", slot) * len(FAKE_CATEGORIES)).cast("int"))


def balanced_epoch(spark: SparkSession, n_real: int, n_fake: int, augment: bool = False, seed: int = 0) -> DataFrame:
    """(slot, label, category, idx): 2 * max(n_real, n_fake) slots, reals first, the smaller side reused in turn.

    Slots are a distributed range and the sample of a slot is a remainder, so the plan needs neither join nor shuffle; an equi-join
    on `idx` with the indexed samples carries it out. A corrupted_real slot takes the real sample of its position.
    """
    if min(n_real, n_fake) < 1:
        raise ValueError("both classes need samples")
    k = max(n_real, n_fake)
    sub = F.col("id") % k
    category = F.when(F.col("id") < k, "real").otherwise(fake_category(sub, augment, seed))
    slots = spark.range(2 * k).select(F.col("id").alias("slot"), sub.alias("_sub"), category.alias("category"))
    idx = F.when(F.col("category").isin("real", "corrupted_real"), F.col("_sub") % n_real).otherwise(F.col("_sub") % n_fake)
    return slots.select("slot", (F.col("category") == "real").cast("int").alias("label"), "category", idx.alias("idx"))


def epoch_samples(epoch: DataFrame, real: DataFrame, fake: DataFrame) -> DataFrame:
    """The epoch's slots with the samples they stand for: adds source, init_time and lead_hours from real and fake rows (idx, source,
    init_time, lead_hours). Real and corrupted_real slots take reals, the others fakes; a join on a unique key.
    """
    keys = ["idx", "source", "init_time", "lead_hours"]
    samples = real.select(*keys, F.lit(True).alias("_real")).unionByName(fake.select(*keys, F.lit(False).alias("_real")))
    return epoch.withColumn("_real", F.col("category").isin("real", "corrupted_real")).join(samples, ["_real", "idx"]).drop("_real")


def with_fields(plan: DataFrame, fields: DataFrame) -> DataFrame:
    """Slots of `epoch_samples` with the fields of their samples, from rows (source, init_time, lead_hours, ...)."""
    return plan.join(fields, ["source", "init_time", "lead_hours"])


def epoch_composition(epoch: DataFrame) -> DataFrame:
    return epoch.groupBy("label", "category").agg(F.count(F.lit(1)).alias("n"))


def eval_set(
    real: DataFrame, fake: DataFrame, disturb_level: float = 0.0, augment_prob: float = 0.0, seed: int = 0
) -> DataFrame:
    """All reals, then all fakes, in one index. A fixed disturbance marks everything fake; else each is corrupted with a probability.

    Adds `slot`, `label` and `corrupted`.
    """
    nr = real.agg(F.count(F.lit(1))).scalar()
    rows = real.select(F.col("idx").alias("slot"), F.lit(1).alias("label")).unionByName(
        fake.select((F.col("idx") + nr).alias("slot"), F.lit(0).alias("label"))
    )
    hit = F.lit(True) if disturb_level > 0 else uniform(seed, "augment", F.col("slot")) < augment_prob
    return rows.withColumn("corrupted", hit).withColumn("label", F.when(F.col("corrupted"), 0).otherwise(F.col("label")))


def sample_metadata(scores: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Scores next to the keys (source, time, lead, label) of their samples."""
    return scores.join(samples, key)
