"""Block-distributed sparse canonical weights against the dense solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dual import blocks_of

from pairlens.operators import block_scca, dual, solve


def problem(spark, n, p, q, seed, width):
    rng = np.random.default_rng(seed)
    signal = rng.normal(size=(n, 2)) * [1.5, 1.0]
    left, right = np.zeros((2, p)), np.zeros((2, q))
    left[0, :5], left[1, 5:9], right[0, :3], right[1, 3:6] = 1, 1, 1, 1
    x, y = signal @ left + rng.normal(size=(n, p)), signal @ right + rng.normal(size=(n, q))
    c = rng.normal(size=(n, 2))
    x, y = x + c @ rng.normal(size=(2, p)), y + c @ rng.normal(size=(2, q))
    data = [(f"s{k:03d}", -1 if k % 5 == 0 else k % 5, c[k].tolist(), x[k].tolist(), y[k].tolist()) for k in range(n)]
    rows = spark.createDataFrame(data, "subject_id string, fold int, c array<double>, x array<double>, b array<double>").repartition(4).persist()
    subjects = dual.read_subjects(rows, columns=["fold"])
    fold = subjects.columns["fold"]
    subset = dual.Subset(0, np.flatnonzero(fold >= 0), np.flatnonzero(fold < 0))
    layout = dual.dual_layout(blocks_of(rows, width), subjects)
    return c, x, y, subset, subjects, layout


def prepared(m, c, subset):
    one = np.column_stack([np.ones(len(c)), c])
    left = m - one @ np.linalg.lstsq(one[subset.train], m[subset.train], rcond=None)[0]
    return left / left[subset.train].std(axis=0)


@pytest.mark.parametrize(("projection", "c1", "c2"), [("raw", 0.1, 0.3), ("paper", 0.2, 0.4), ("raw", 1.0, 1.0)])
def test_equals_the_dense_solver(spark, projection, c1, c2):
    c, x, y, subset, subjects, layout = problem(spark, 120, 64, 8, 1, 16)
    got = block_scca.block_scca(layout, subjects, subset, 2, c1, c2, projection, max_iter=60, tol=1e-7)
    zx, zy = prepared(x, c, subset), prepared(y, c, subset)
    t = subset.train
    a, b = solve.scca(zx[t].T @ zy[t] / len(t), 2, c1, c2, projection=projection, max_iter=60, tol=1e-7)
    table = got.table().withColumn("at", F.substring("block", 2, 9).cast("int") * 16 + F.col("dim")).orderBy("component", "at").toPandas()
    u = table.weight.to_numpy().reshape(2, 64).T
    assert np.allclose(u, a, atol=1e-5) and np.allclose(got.v, b, atol=1e-5)
    assert np.allclose(got.sparsity, (np.abs(a) < 1e-12).mean(axis=0))
    for rows, r in ((t, got.r_train), (subset.score, got.r_score)):
        want = [np.corrcoef(zx[rows] @ a[:, k], zy[rows] @ b[:, k])[0, 1] for k in range(2)]
        assert np.allclose(r, want, atol=1e-5)


def test_more_features_than_moments_take(spark):
    """5,000 features, beyond the moment matrix: the planted ones are found."""
    _, _, _, subset, subjects, layout = problem(spark, 100, 5000, 6, 2, 500)
    got = block_scca.block_scca(layout, subjects, subset, 1, 0.05, 0.6, "paper", max_iter=8, tol=1e-3)
    top = got.table().orderBy(F.abs("weight").desc()).limit(5).collect()
    assert {r["block"] for r in top} == {"g0"} and {r["dim"] for r in top} <= set(range(9))
    assert got.sparsity[0] > 0.9 and got.r_train[0] > 0.6 and got.r_score[0] > 0.3


def test_folds_weights_and_loadings(spark):
    """The plan: every fold and the final fit, loadings as correlations with the variate."""
    from pairlens.plans import wide

    c, x, y, subset, subjects, layout = problem(spark, 60, 24, 4, 3, 8)
    rows = spark.createDataFrame([(str(s), int(f), c[k].tolist(), x[k].tolist(), y[k].tolist()) for k, (s, f) in enumerate(zip(subjects.ids, subjects.columns["fold"]))], "subject_id string, fold int, c array<double>, x array<double>, b array<double>")
    got = wide.wide_sparse(blocks_of(rows, 8), rows.select("subject_id", "fold", "c", "b"), 1, 0.3, 0.5, max_iter=15, tol=1e-4, top=3)
    folds = got["folds"].toPandas().set_index("fold")
    assert sorted(folds.index) == [-1, 1, 2, 3, 4] and (folds.r_train > 0.3).all()
    zx, zy = prepared(x, c, subset), prepared(y, c, subset)
    t = subset.train
    a, b = solve.scca(zx[t].T @ zy[t] / len(t), 1, 0.3, 0.5, max_iter=15, tol=1e-4)
    table = got["x_weights"].withColumn("at", F.substring("gene", 2, 9).cast("int") * 8 + F.col("dim")).orderBy("at").toPandas()
    assert np.allclose(table.weight, a[:, 0], atol=1e-3)
    variate = zx[t] @ table.weight.to_numpy()
    assert np.allclose(table.loading, [np.corrcoef(zx[t][:, j], variate)[0, 1] for j in range(24)], atol=1e-8)
    assert np.isclose(folds.loc[-1].r_val, np.corrcoef(zx[subset.score] @ a[:, 0], zy[subset.score] @ b[:, 0])[0, 1], atol=1e-2)
    assert got["top_x_weights"].count() == 3 == got["top_x_loadings"].count()
