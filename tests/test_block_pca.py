"""Block PCA against the SVD of the concatenated matrix."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators import block_pca as bp

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def data(spark):
    n, genes, width = 150, 5, 12
    base = RNG.standard_normal((n, 6)) * [9, 7, 5, 3, 2, 1]
    x = base @ RNG.standard_normal((6, genes * width)) + 0.3 * RNG.standard_normal((n, genes * width))
    age = RNG.standard_normal(n) * 8 + 60
    x += 0.2 * age[:, None]
    x[:, 3] = 1.5  # constant feature
    rows = [(f"s{i}", f"g{g}", x[i, g * width : (g + 1) * width].tolist()) for i in range(n) for g in range(genes)]
    blocks = spark.createDataFrame(pd.DataFrame(rows, columns=["subject_id", "gene", "embedding"])).repartition(7)
    cov = spark.createDataFrame(pd.DataFrame({"subject_id": [f"s{i}" for i in range(n)], "covariates": [[a] for a in age]}))
    return x, age, blocks, cov


def test_matches_svd_on_training_rows(spark, data):
    x, age, blocks, cov = data
    train = np.arange(len(x)) % 3 != 0
    flag = F.expr("cast(substr(subject_id, 2) as int) % 3 <> 0")
    model, scores = bp.block_pca(blocks, 3, cov, flag, passes=10)
    c = np.column_stack([np.ones(len(x)), age])
    r = x - c @ np.linalg.lstsq(c[train], x[train], rcond=None)[0]
    sd = r[train].std(0)
    r = (r - r[train].mean(0)) / np.where(sd < 1e-9, 1.0, sd)
    _, s, vt = np.linalg.svd(r[train], full_matrices=False)
    assert np.allclose(model.eigenvalues, s[:3] ** 2 / train.sum(), rtol=1e-5)
    assert abs(model.total_variance - 59) < 1e-6 and 0 < model.explained_variance_ratio <= 1
    got = scores.toPandas().set_index("subject_id")["pcs"]
    want = r @ vt[:3].T
    mat = np.array([got[f"s{i}"] for i in range(len(x))])
    assert np.allclose(np.abs(mat), np.abs(want), atol=1e-3)


def test_batches_may_cut_through_a_subject(spark, data):
    x, age, blocks, cov = data
    model, scores = bp.block_pca(blocks, 2, cov)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        small, again = bp.block_pca(blocks, 2, cov)
        assert np.allclose(model.eigenvalues, small.eigenvalues, rtol=1e-8)
        assert again.count() == scores.count() == len(x)
    finally:
        spark.conf.set(key, before)


def test_components_table_maps_back(spark, data):
    _, _, blocks, cov = data
    model, _ = bp.block_pca(blocks, 2, cov)
    table = bp.components_table(spark, model)
    norms = table.groupBy("pc").agg(F.sum(F.col("loading") ** 2).alias("s")).toPandas()
    assert np.allclose(norms["s"], 1.0)


def test_size_check(spark, data, monkeypatch):
    monkeypatch.setattr(bp, "MAX_DIRECTION_CELLS", 10)
    with pytest.raises(ValueError, match="too large"):
        bp.block_pca(data[2], 2)


def test_wide_grid_equals_moment_grid(spark, data):
    """With all components kept, refitting block PCA per fold equals the grid on moments."""
    from pairlens.operators import reports
    from pairlens.operators.moments import Layout, z_vector
    from pairlens.plans import coupling

    x, age, blocks, _ = data
    n = len(x)
    pdf = pd.DataFrame({"subject_id": [f"s{i}" for i in range(n)], "c": [[a] for a in age], "x": list(x[:, :8]), "b": list(x[:, 20:23] + RNG.standard_normal((n, 3)))})
    rows = coupling.assign_splits(spark.createDataFrame(pdf), n_folds=3, label=None).cache()
    two = F.array(*[F.struct(F.lit(f"g{i}").alias("gene"), F.slice("x", 4 * i + 1, 4).alias("embedding")) for i in range(2)])
    grid = reports.config_grid(spark, ["cca", "scca"], [2, 5], [0.5], 5)
    z = z_vector(F.col("c"), F.col("x"), F.col("b"))
    want = coupling.coupling_grid(rows, z, Layout(1, 8, 3), grid, n_components=2).toPandas().set_index("config")
    got = coupling.wide_coupling_grid(rows.select("subject_id", F.inline(two)), rows.drop("x"), 1, 3, grid, n_components=2).toPandas().set_index("config")
    for c in ("mean_train", "mean_val", "r_holdout"):
        assert np.allclose(got.loc[want.index, c], want[c], atol=1e-5), c


def test_absent_blocks_are_errors(spark, data):
    _, _, blocks, cov = data
    some = blocks.filter("not (gene = 'g1' and cast(substr(subject_id, 2) as int) < 40)")
    with pytest.raises(ValueError, match="every subject needs every block"):
        bp.block_pca(some, 2, cov)
    train = F.expr("cast(substr(subject_id, 2) as int) >= 40")
    model, scores = bp.block_pca(some, 2, cov, train)
    with pytest.raises(Exception, match="every subject needs every block once"):
        scores.collect()
    assert model.passes >= 1


def test_unsettled_eigenvalues_are_errors(spark, data):
    _, _, blocks, cov = data
    with pytest.raises(RuntimeError, match="have not settled"):
        bp.block_pca(blocks, 2, cov, passes=1, oversample=0)
