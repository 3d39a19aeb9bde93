"""Perceptrons against NumPy: one step, a whole run, early stopping, and the wide suite."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_dual import blocks_of

from pairlens.catalog import estimators
from pairlens.operators import mlp
from pairlens.operators.classify import FoldModel
from pairlens.plans import coupling, suite, wide


@pytest.fixture(scope="module")
def rows(spark):
    """A label that no linear score can tell: the product of two signs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    data = [(k, [-1, 0, 1, 2][k % 4], int(y[k]), [1.0, *x[k].tolist()]) for k in range(600)]
    return spark.createDataFrame(data, "id int, fold int, y int, z array<double>").repartition(6).persist()


def model(fold, name="m"):
    return FoldModel(name, fold, np.eye(5), (1.0, 1.0))


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    net = mlp.new_net(model(0), (5, 3), 1)
    x, y = rng.normal(size=(20, 4)), rng.integers(0, 2, 20).astype(float)
    grad, loss = mlp.gradient(net.theta, net.sizes, x, y)
    for at in range(0, len(net.theta), 3):
        step = np.zeros_like(net.theta)
        step[at] = 1e-6
        slope = (mlp.gradient(net.theta + step, net.sizes, x, y)[1] - mlp.gradient(net.theta - step, net.sizes, x, y)[1]) / 2e-6
        assert np.isclose(slope, grad[at], atol=1e-5)
    assert np.isclose(loss, mlp.log_loss(mlp.forward(net.theta, net.sizes, x)[-1][:, 0], y))


def test_first_steps_of_all_networks_equal_numpy(spark, rows):
    """Two epochs of three networks trained in the same passes."""
    models = [model(0), model(1), model(-1, "other")]
    nets = mlp.fit_mlps(rows, models, (6, 3), rate=0.05, alpha=0.1, max_epochs=2, validation=0.2, patience=50, tol=-10.0)
    pdf = rows.withColumn("aside", F.pmod(F.xxhash64(F.lit(42), "z"), F.lit(1_000_000)) < 200_000).toPandas()
    x, y, fold, aside = np.vstack(pdf.z)[:, 1:], pdf.y.to_numpy(float), pdf.fold.to_numpy(), pdf.aside.to_numpy()
    assert 60 < aside.sum() < 180
    for net, m in zip(nets, models):
        own = (fold != m.fold) & (fold != -1)
        fit, held = own & ~aside, own & aside
        theta = mlp.new_net(m, (6, 3), 42).theta
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for t in (1, 2):
            grad, loss = mlp.gradient(theta, net.sizes, x[fit], y[fit])
            assert np.isclose(net.history[t - 1][0], loss / fit.sum())
            assert np.isclose(net.history[t - 1][1], mlp.log_loss(mlp.forward(theta, net.sizes, x[held])[-1][:, 0], y[held]) / held.sum())
            grad = grad / fit.sum()
            at = 0
            for a, b in zip(net.sizes, net.sizes[1:]):
                grad[at : at + a * b] += 0.1 / fit.sum() * theta[at : at + a * b]
                at += a * b + b
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            theta = theta - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        assert np.allclose(net.theta, theta, atol=1e-10)


def test_learns_what_no_line_can(spark, rows):
    nets = mlp.fit_mlps(rows, [model(0), model(-1)], (16, 8), rate=0.03, max_epochs=60)
    scores = mlp.score_mlps(rows, nets, ["id", "y"]).toPandas()
    assert set(scores.fold) == {0, -1} and len(scores) == 300
    for fold in (0, -1):
        own = scores[scores.fold == fold]
        pos, neg = own[own.y == 1].score.to_numpy(), own[own.y == 0].score.to_numpy()
        assert (pos[:, None] > neg).mean() > 0.9
        assert ((own.score > 0.5).astype(int) == own.yhat).all()


def test_stops_early_with_the_best_weights(spark, rows):
    net = mlp.fit_mlps(rows, [model(0)], (4,), rate=2.0, max_epochs=40, patience=3)[0]
    held = [h for _, h in net.history]
    assert len(held) < 41 and len(held) - 1 - int(np.argmin(held)) >= 3
    again = mlp.epoch_sums(rows.withColumn("aside", F.pmod(F.xxhash64(F.lit(42), "z"), F.lit(1_000_000)) < 100_000), [net])[0]
    assert np.isclose(again[-2] / again[-1], min(held), atol=1e-4)


def test_wide_suite_equals_the_narrow_one(spark):
    """All 32 values in blocks with components per fold: the same scores as from moments."""
    rows = coupling.assign_splits(estimators.pairs(spark, SF), n_folds=3).persist()
    side = rows.select("subject_id", "fold", "y", "c", "b")
    for scope in ("fold", "train"):
        want = suite.cross_validated_scores(rows, estimators.z_full(), estimators.L_FULL, suite.REPRESENTATIONS, ["logreg"], pca_dim=6, k=3, scope=scope).toPandas()
        got = wide.wide_scores(blocks_of(rows), side, 6, k=3, scope=scope).toPandas()
        both = want.merge(got, on=["subject_id", "fold", "model", "split"], suffixes=("", "_wide"))
        assert len(both) == len(want) == len(got)
        far = both[~np.isclose(both.score, both.score_wide, atol=1e-6)]
        assert far.empty, (scope, far.groupby(["model", "fold"]).size())


def test_wide_suite_with_perceptrons(spark):
    rows = coupling.assign_splits(estimators.pairs(spark, SF), n_folds=2)
    got = wide.wide_suite(blocks_of(rows), rows.select("subject_id", "fold", "y", "c", "b"), 4, representations=["gene_only", "early_fusion"], classifiers=["mlp"], hidden=(4,), mlp_iter=3).collect()
    assert {(r["model"], r["split"]) for r in got} == {(f"{n}_mlp", s) for n in ("gene_only", "early_fusion") for s in ("cv", "holdout")}
    assert all(0 <= r["auc"] <= 1 for r in got)
