import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("fieldlab-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from fieldlab.deploy import ship_package

    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def snapshots(spark):
    """Three samples of four 6 x 9 fields with known values, and the same as a NumPy array."""
    import numpy as np

    data = np.random.default_rng(0).normal(size=(3, 4, 6, 9))
    rows = [(s, "ref" if s else "cand", v, 6, 9, data[s, i].ravel().tolist()) for s in range(3) for i, v in enumerate("tuvp")]
    return spark.createDataFrame(rows, "sample_id long, source string, variable string, h int, w int, values array<double>"), data
