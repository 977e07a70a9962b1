"""Plug a trained model into a query as a column function."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from fieldlab.functions.arrays import DOUBLES


def encoder(spark: SparkSession, model: Any, predict: Callable[[Any, np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """Vector column to vector column: `predict(model, batch)` maps (N, D) to (N, K). The model is broadcast once per executor."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf(DOUBLES)
    def encode(vec: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(predict(shared.value, np.stack(vec.to_numpy())), dtype=float)))

    return encode


def critic(spark: SparkSession, model: Any, predict: Callable[[Any, np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """Vector column to logit column: `predict(model, batch)` maps (N, D) to (N,)."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf(DoubleType())
    def score(vec: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(predict(shared.value, np.stack(vec.to_numpy())), dtype=float))

    return score
