import glob
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

# One query per family against its SQL; `check.py` compares all of them.
SAMPLE = [
    "select_time_ranges", "even_subsample", "compose_phase", "diff_snapshots", "asof_nearest", "pair_valid_time", "corrupt_patch_shuffle",
    "corrupt_blur_gaps", "corrupt_padded", "corruption_plan", "psd_radial", "psd_histogram", "epoch_fields", "mask_context", "mask_contexts",
    "kfold_pools", "pool_dedup", "kfold_gradients", "kfold_evaluation", "holdout_pairs", "logits_by_disturbance", "mmd_rbf", "frechet_plane",
    "pca_plane", "reverse_kl_by_lead", "reverse_kl_per_critic", "latent_pipeline",
]


def test_registry():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and len(queries) > 160 and len(sqls) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["source", "lead_hours", "score", "stderr", "n"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, FOLDER)
    want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want
