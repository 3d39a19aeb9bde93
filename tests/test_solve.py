"""Dense solves against direct computations on rows."""

import numpy as np
import pytest

from pairlens.operators import solve
from pairlens.operators.moments import Layout

RNG = np.random.default_rng(0)


def planted(n=400, p=12, q=7, noise=0.5):
    t = RNG.standard_normal(n)
    x, y = RNG.standard_normal((n, p)), RNG.standard_normal((n, q))
    x[:, :4] += t[:, None] / noise
    y[:, :3] += t[:, None] / noise
    c = RNG.standard_normal((n, 2)) * [3, 1] + [60, 0.5]
    x[:, 0] += 0.3 * c[:, 0]
    return np.hstack([np.ones((n, 1)), c, x, y]), Layout(2, p, q)


def gram(z):
    return z.T @ z


def by_rows(z, layout, train):
    """Residualize and scale with train statistics, directly on the rows."""
    c, f = z[:, layout.cov], z[:, layout.x.start :]
    b = np.linalg.lstsq(c[train], f[train], rcond=None)[0]
    r = f - c @ b
    return (r - r[train].mean(0)) / r[train].std(0)


def test_prep_matches_rows():
    z, layout = planted()
    train = np.arange(len(z)) < 300
    w = solve.linear_prep(gram(z[train]), layout)
    assert np.allclose(z @ w, by_rows(z, layout, train), atol=1e-8)


def test_constant_feature_keeps_unit_scale():
    z, layout = planted()
    z[:, layout.x.start + 1] = 5.0
    w = solve.linear_prep(gram(z), layout)
    assert np.abs((z @ w)[:, 1]).max() < 1e-6


@pytest.mark.parametrize("method", ["cca", "scca"])
@pytest.mark.parametrize("dim", [3, 12])
def test_validation_score_from_moments_equals_rows(method, dim):
    z, layout = planted()
    train = np.arange(len(z)) < 300
    model = solve.PairModel(gram(z[train]), layout, dim)
    fit = model.fit(method, dim, 2, 0.4, 0.4)
    f = by_rows(z, layout, train)
    x = f[:, : layout.p]
    comps = np.linalg.svd(x[train], full_matrices=False)[2][:dim].T
    comps = comps * np.sign(np.sum(comps * fit.x_components, axis=0))
    u, v = x @ comps @ fit.a, f[:, layout.p :] @ fit.b
    for rows, got in ((train, fit.r_train), (~train, model.score(fit, gram(z[~train])))):
        want = [np.corrcoef(u[rows, i], v[rows, i])[0, 1] for i in range(2)]
        assert np.allclose(got, want, atol=1e-8)


def test_cca_equals_qr_solution():
    z, layout = planted()
    f = by_rows(z, layout, np.ones(len(z), bool))
    qx, qy = np.linalg.qr(f[:, : layout.p])[0], np.linalg.qr(f[:, layout.p :])[0]
    want = np.linalg.svd(qx.T @ qy, compute_uv=False)
    fit = solve.PairModel(gram(z), layout).fit("cca", layout.p, 7)
    assert np.allclose(fit.r_train, want, atol=1e-8)


def test_cca_survives_rank_deficiency():
    z, layout = planted()
    z[:, layout.x.start + 2] = z[:, layout.x.start + 1]
    fit = solve.PairModel(gram(z), layout).fit("cca", layout.p, 3)
    assert np.isfinite(fit.a).all() and (fit.r_train <= 1 + 1e-9).all()


@pytest.mark.parametrize("bound", [1.2, 2.0, 3.0])
def test_l1_unit_equals_bisection(bound):
    x = RNG.standard_normal(40)
    lo, hi = 0.0, np.abs(x).max()
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.maximum(np.abs(x) - mid, 0).sum() > bound else (lo, mid)
    want = np.sign(x) * np.maximum(np.abs(x) - lo, 0)
    assert np.allclose(solve.l1_unit(x, bound), want / np.linalg.norm(want), atol=1e-9)
    paper = solve.l1_unit(x, bound, paper=True)
    assert abs(np.linalg.norm(paper) - 1) < 1e-9 and np.abs(paper).sum() <= bound + 1e-6


def test_deflating_the_cross_covariance_equals_deflating_the_views():
    z, layout = planted()
    f = by_rows(z, layout, np.ones(len(z), bool))
    x, y = f[:, : layout.p], f[:, layout.p :]
    us, vs = solve.scca(x.T @ y / len(z), 3, 0.5, 0.5)
    for k in range(1, 3):
        for j in range(k):
            x_res = x - np.outer(x @ us[:, j], us[:, j]) if j == 0 else x_res - np.outer(x_res @ us[:, j], us[:, j])
            y_res = y - np.outer(y @ vs[:, j], vs[:, j]) if j == 0 else y_res - np.outer(y_res @ vs[:, j], vs[:, j])
        s = x_res.T @ y_res / len(z)
        again = solve.scca(s, 1, 0.5, 0.5)[0][:, 0]
        assert np.allclose(np.abs(again), np.abs(us[:, k]), atol=1e-5)


def test_planted_signal_gets_the_weight_and_zeros_appear():
    z, layout = planted(noise=0.3)
    fit = solve.PairModel(gram(z), layout).fit("scca", layout.p, 1, 0.3, 0.3, projection="paper")
    a, b = np.abs(fit.a[:, 0]), np.abs(fit.b[:, 0])
    assert a[:4].sum() > 0.9 * a.sum() and b[:3].sum() > 0.9 * b.sum()
    assert (a == 0).any() and fit.r_train[0] > 0.8


def test_loadings_are_correlations():
    z, layout = planted()
    f = by_rows(z, layout, np.ones(len(z), bool))
    model = solve.PairModel(gram(z), layout)
    fit = model.fit("cca", layout.p, 2)
    got = solve.loadings(model.cov[layout.p :, layout.p :], fit.b, model.n)
    y, v = f[:, layout.p :], f[:, layout.p :] @ fit.b
    want = np.corrcoef(y.T, v.T)[: layout.q, layout.q :]
    assert np.allclose(got, want, atol=1e-9)
    assert (solve.loadings(model.cov, np.zeros((19, 1)), 2) == 0).all()
