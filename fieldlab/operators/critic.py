"""Linear critics: fit real-vs-fake classifiers, score snapshots, and run hold-out schemes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.functions.keyed import uniform_value
from fieldlab.functions.reuse import stored
from fieldlab.operators.catalog import FULL_POOL
from fieldlab.operators.distance import merge_as_tree


def dot(vec: Column, weights: Sequence[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vec, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def keyed_weights(critic: int, dim: int) -> list[float]:
    """Fixed weights in [-1, 1) of a demonstration critic."""
    return [2.0 * uniform_value("critic", critic, i) - 1.0 for i in range(dim)]


def score_critic(df: DataFrame, critics: dict, vec: str = "vec") -> DataFrame:
    """Rows times critics, with `critic` and `logit`.

    `critics` maps a name to (weights, intercept), or to any function from the vector column to a logit column.
    """

    def logit(c) -> Column:
        return c(F.col(vec)) if callable(c) else dot(F.col(vec), c[0]) + c[1]

    scores = F.array(*[F.struct(F.lit(name).alias("critic"), logit(c).alias("logit")) for name, c in critics.items()])
    keep = [c for c in df.columns if c != vec]
    return df.select(*keep, F.explode(scores).alias("_s")).select(*keep, "_s.*")


def fit_critic(df: DataFrame, label: str = "label", vec: str = "vec", reg: float = 0.0, max_iter: int = 100):
    """Logistic regression of label (1 real, 0 fake) on the feature vector; returns (weights, intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = df.select(F.col(label).cast("double").alias("_y"), array_to_vector(F.col(vec).cast("array<double>")).alias("_x"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=reg, maxIter=max_iter).fit(data)
    return [float(c) for c in model.coefficients], float(model.intercept)


def fit_folds(samples: DataFrame, label: str = "label", vec: str = "vec", reg: float = 0.01, tolerance: float = 1e-10, turns: int = 50) -> DataFrame:
    """(fold, n, weights, intercept): one logistic regression per fold, all fitted together by Newton's method.

    samples(folds, label, vec) name the folds that a row trains. The loss is the mean log loss plus reg / 2 times the squared weights (not
    the intercept). A turn is one pass over the samples for all folds: tasks add up gradient and Hessian per fold, and these sums are
    merged as a tree and solved, so the number of jobs does not grow with the folds. It ends when no weight moves by more than
    `tolerance`; folds that have not settled after `turns` are an error.
    """
    rows = stored(samples.select(F.explode("folds").alias("fold"), F.col(label).cast("double").alias("y"), F.col(vec).cast("array<double>").alias("x")))
    state = None
    for _ in range(turns):
        known = rows if state is None else rows.withColumn("_all", state.agg(F.map_from_entries(F.collect_list(F.struct("fold", "w")))).scalar())
        aimed = known.withColumn("w", F.lit(None).cast("array<double>") if state is None else F.try_element_at("_all", F.col("fold")))

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for batch in batches:
                for fold, part in batch.groupby("fold"):
                    x = np.stack(part["x"].to_numpy())
                    x = np.hstack([x, np.ones((len(x), 1))])
                    w = np.zeros(x.shape[1]) if part["w"].iloc[0] is None else np.asarray(part["w"].iloc[0], float)
                    p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
                    fresh = [len(x), w, x.T @ (p - part["y"].to_numpy()), (x * (p * (1 - p))[:, None]).T @ x]
                    old = total.get(fold)
                    total[fold] = fresh if old is None else [old[0] + fresh[0], w, old[2] + fresh[2], old[3] + fresh[3]]
            task = TaskContext.get().partitionId()
            out = [(f, n, w, g, h.ravel(), task, 0) for f, (n, w, g, h) in total.items()]
            yield pd.DataFrame(out, columns=["fold", "n", "w", "g", "h", "task", "turn"])

        def merge(part: pd.DataFrame) -> pd.DataFrame:
            head = part.iloc[:1].copy()
            head["n"], head["g"], head["h"] = part["n"].sum(), [part["g"].sum()], [part["h"].sum()]
            return head[["fold", "n", "w", "g", "h"]]

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                moved, fresh = [], []
                for n, w, g, h in zip(batch["n"], batch["w"], batch["g"], batch["h"]):
                    d = len(w)
                    ridge = np.full(d, reg)
                    ridge[-1] = 0.0
                    hessian = np.reshape(h, (d, d)) / n + np.diag(ridge + 1e-12)
                    change = np.linalg.solve(hessian, np.asarray(g) / n + ridge * w)
                    change *= min(1.0, 10.0 / max(np.abs(change).max(), 1e-300))  # a first step from far away stays bounded
                    moved.append(np.abs(change).max())
                    fresh.append(w - change)
                yield pd.DataFrame({"fold": batch["fold"], "n": batch["n"], "w": fresh, "moved": moved})

        schema = "fold string, n long, w array<double>, g array<double>, h array<double>"
        partial = stored(aimed.select("fold", "y", "x", "w").mapInPandas(sums, f"{schema}, task long, turn long"))
        state = stored(merge_as_tree(partial, ["fold"], merge, schema).mapInPandas(step, "fold string, n long, w array<double>, moved double"))
        if (state.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            return state.select("fold", "n", F.expr("slice(w, 1, size(w) - 1)").alias("weights"), F.element_at("w", -1).alias("intercept"))
    raise ValueError(f"some fold has not settled after {turns} turns")


def score_folds(samples: DataFrame, critics: DataFrame, mine: Callable[[Column], Column], vec: str = "vec") -> DataFrame:
    """Rows with `critic` and `logit` for each critic of critics(fold, weights, intercept) whose fold `mine` accepts for the row."""
    listed = critics.agg(F.sort_array(F.collect_list(F.struct("fold", "weights", "intercept")))).scalar()  # one entry per fold
    rows = samples.withColumn("_c", listed).withColumn("_c", F.explode("_c")).where(mine(F.col("_c.fold")))
    logit = F.aggregate(F.zip_with(vec, "_c.weights", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) + F.col("_c.intercept")
    return rows.select(*[c for c in samples.columns if c != vec], F.col("_c.fold").alias("critic"), logit.alias("logit"))


def left_out_folds(samples: DataFrame, model: str = "model", label: str = "label") -> DataFrame:
    """Samples with the `folds` that they train: one fold per model, named after it, which that model's fakes don't train, and `full_pool`."""
    models = samples.where(F.col(label) == 0).agg(F.sort_array(F.collect_set(model))).scalar()
    every = F.concat(F.col("_m"), F.array(F.lit(FULL_POOL)))
    named = samples.withColumn("_m", models)
    return named.withColumn("folds", F.when(F.col(label) == 1, every).otherwise(F.array_remove(every, F.col(model)))).drop("_m")


def pooled_folds(samples: DataFrame, pools: dict[str, Sequence[str]], model: str = "model", label: str = "label") -> DataFrame:
    """Samples with the `folds` that they train: reference rows train all, fakes those whose pool has their model."""
    for fold, pool in pools.items():
        if not pool:
            raise ValueError(f"no training files for {fold}")
    each = [F.when((F.col(label) == 1) | F.col(model).isin(list(pool)), F.lit(fold)) for fold, pool in pools.items()]
    return samples.withColumn("folds", F.array_compact(F.array(*each)))


def own_holdout_scores(samples: DataFrame, critics: dict, model: str = "model") -> DataFrame:
    """Scores of each critic on the reference and on the model it never saw (critic name = held-out model)."""
    scored = score_critic(samples, critics)
    return scored.where((F.col("label") == 1) | (F.col(model) == F.col("critic")))
