"""Estimators on all 32 x 32 values with covariates, against NumPy."""

import __spark_entry__
import numpy as np
import pytest
from conftest import SF

from pairlens.catalog import estimators
from pairlens.operators.splits import split_by_label
from pairlens.plans import coupling


def prepared(t, e):
    """Both parts residualized and scaled by the training part; t and e are (c, x, b)."""
    out = []
    for k in (1, 2):
        design = [np.column_stack([np.ones(len(p[0])), p[0]]) for p in (t, e)]
        beta = np.linalg.lstsq(design[0], t[k], rcond=None)[0]
        rt, re = t[k] - design[0] @ beta, e[k] - design[1] @ beta
        out.append((rt / rt.std(axis=0), re / rt.std(axis=0)))
    return out


def first_pair(t, e, dim):
    """Train and evaluation correlation of the first canonical pair of `dim` principal components of x and the whole of y."""
    (xt, xe), (yt, ye) = prepared(t, e)
    main = np.linalg.svd(xt, full_matrices=False)[2][:dim].T
    xt, xe = xt @ main, xe @ main
    (qx, rx), (qy, ry) = np.linalg.qr(xt), np.linalg.qr(yt)
    u, r, v = np.linalg.svd(qx.T @ qy)
    a, b = np.linalg.solve(rx, u[:, 0]), np.linalg.solve(ry, v[0])
    return r[0], np.corrcoef(xe @ a, ye @ b)[0, 1]


def arrays(pdf):
    return tuple(np.vstack(pdf[c]) for c in ("c", "x", "b"))


def cv(pdf, dim):
    train = pdf[pdf.fold >= 0]
    folds = [first_pair(arrays(train[train.fold != f]), arrays(train[train.fold == f]), dim) for f in sorted(train.fold.unique())]
    final = first_pair(arrays(train), arrays(pdf[pdf.fold < 0]), dim)
    return np.array([np.mean([f[0] for f in folds]), np.mean([f[1] for f in folds]), np.std([f[1] for f in folds]), *final])


@pytest.fixture(scope="module")
def table(spark):
    return coupling.assign_splits(estimators.pairs(spark, SF)).select("subject_id", "y", "fold", "c", "x", "b").toPandas()


def values(df):
    return {r["config"]: np.array([r[c] for c in estimators._GRID_COLS]) for r in df.collect()}


def test_entry_fits_whole_views(spark, table):
    got = values(__spark_entry__.entry(spark))
    assert len(got) == 6
    for dim in estimators.WHOLE_DIMS:
        assert np.allclose(got[f"cca_pca{dim}"], cv(table, dim), atol=1e-6)


def test_blocks_give_the_same_grid(spark, table):
    got = values(estimators.whole_grid_wide(spark, SF))
    for dim in (2, 8):
        assert np.allclose(got[f"cca_pca{dim}"], cv(table, dim), atol=1e-5)


@pytest.mark.parametrize("cached", [False, True])
def test_groups_on_whole_views(spark, cached):
    rows = coupling.assign_splits(split_by_label(estimators.pairs(spark, SF)), group="grp").select("grp", "fold", "c", "x", "b").toPandas()
    got = estimators.whole_stratified(spark, SF, cached).first()
    for name in ("case", "control"):
        own = rows[rows.grp == name]
        assert np.isclose(got[f"r_{name}"], cv(own, int(got[f"{name}_config"].removeprefix("cca_pca")))[4], atol=1e-6)


def test_observed_correlations_of_whole_views(spark, table):
    observed, null = estimators.whole_permutations(spark, SF, 20)
    every = arrays(table)
    (x, _), (y, _) = prepared(every, every)
    want = np.linalg.svd(np.linalg.qr(x)[0].T @ np.linalg.qr(y)[0], compute_uv=False)
    assert np.allclose(observed, want, atol=1e-8) and null.count() == 20 * 32
