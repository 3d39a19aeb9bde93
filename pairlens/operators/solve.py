"""Small dense solves on moment matrices (features x features, never rows).

Everything takes and returns NumPy arrays whose size depends on the number of
features, and runs on the driver or inside the task of one grid cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RIDGE = 1e-8
ZERO_VARIANCE = 1e-12


def linear_prep(m: np.ndarray, layout, residualize: bool = True, standardize: bool = True) -> np.ndarray:
    """Map W with z W = prepared [x, y]: covariates regressed out, then scaled, on the rows behind `m`."""
    first = layout.x.start
    d = layout.dim
    w = np.zeros((d, d - first))
    w[first:, :] = np.eye(d - first)
    if residualize:
        c = layout.cov
        ctc, ctf = m[c, c], m[c, first:]
        w[c, :] = -np.linalg.lstsq(ctc, ctf, rcond=None)[0]
    if standardize:
        n = m[0, 0]
        mean = (m[0, :] @ w) / n
        second = np.einsum("ij,ij->j", w, m @ w) / n
        var = second - mean**2
        raw = np.diag(m)[first:] / n
        constant = var <= ZERO_VARIANCE * np.maximum(raw, 1e-300)
        sd = np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, var)))
        w[0, :] -= mean
        w = w / sd
    return w


def covariance(m: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and population covariance of z w over the rows behind `m`."""
    n = m[0, 0]
    if n <= 0:
        k = w.shape[1]
        return 0.0, np.zeros(k), np.zeros((k, k))
    mean = (m[0, :] @ w) / n
    return float(n), mean, w.T @ m @ w / n - np.outer(mean, mean)


def fix_signs(v: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Make the largest |entry| of every column positive; partners flip along."""
    if v.size == 0:
        return (v, *others)
    sign = np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])
    sign[sign == 0] = 1.0
    return tuple(a * sign for a in (v, *others))


def pca(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and components (features x k) of a covariance matrix."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: min(k, len(values))]
    return np.maximum(values[order], 0.0), fix_signs(vectors[:, order])[0]


def _inverse_root(s: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(s)
    keep = values > RIDGE * max(values.max(initial=0.0), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


def cca(sxx: np.ndarray, sxy: np.ndarray, syy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical weights of both views (unit-variance variates) and correlations."""
    rx, ry = _inverse_root(sxx), _inverse_root(syy)
    left, r, right = np.linalg.svd(rx.T @ sxy @ ry, full_matrices=False)
    k = min(k, len(r))
    a, b = rx @ left[:, :k], ry @ right[:k].T
    a, b = fix_signs(a, b)
    return a, b, np.clip(r[:k], 0.0, 1.0)


def l1_unit(x: np.ndarray, bound: float, paper: bool = False) -> np.ndarray:
    """Soft-threshold to an L1 bound, then scale to unit length.

    The bound applies to the vector as it comes (default) or, with `paper`, to the
    unit-length result. The threshold is found exactly from the sorted magnitudes.
    """
    norm = np.linalg.norm(x)
    if norm <= 1e-10:
        return x
    mag = np.abs(x)
    if not paper:
        if mag.sum() <= bound:
            return x / norm
        desc = np.sort(mag)[::-1]
        lam = (np.cumsum(desc) - bound) / np.arange(1, len(desc) + 1)
        lam = lam[np.nonzero(desc > lam)[0][-1]]
    else:
        if mag.sum() / norm <= bound:
            return x / norm
        lo, hi = 0.0, float(mag.max())
        for _ in range(60):
            lam = (lo + hi) / 2
            t = np.maximum(mag - lam, 0)
            length = np.linalg.norm(t)
            lo, hi = (lam, hi) if length > 0 and t.sum() / length > bound else (lo, lam)
        lam = lo
    out = np.sign(x) * np.maximum(mag - lam, 0)
    length = np.linalg.norm(out)
    return out / length if length > 1e-10 else out


def l1_bound(c: float, p: int, rule: str = "interpolate") -> float:
    """c <= 1 is a fraction: of the way from 1 to sqrt(p), or of sqrt(p) itself with rule `fraction`."""
    if rule == "fraction":
        return c * np.sqrt(p)
    return 1 + c * (np.sqrt(p) - 1) if c <= 1.0 else c


def scca(
    sxy: np.ndarray,
    k: int,
    c1: float,
    c2: float,
    bound: str = "interpolate",
    projection: str = "raw",
    max_iter: int = 500,
    tol: float = 1e-6,
) -> tuple[np.ndarray, np.ndarray]:
    """Sparse canonical weights by penalized matrix decomposition of the cross-covariance.

    Deflating both data views by their component is the same as projecting it out of
    the cross-covariance, so no data pass is needed between components. Starts from
    the leading singular vector, which makes the result deterministic.
    """
    s = sxy.copy()
    p, q = s.shape
    b1, b2 = l1_bound(c1, p, bound), l1_bound(c2, q, bound)
    paper = projection == "paper"
    us, vs = np.zeros((p, k)), np.zeros((q, k))
    for comp in range(k):
        if bound == "fraction":
            # Sparse weights are not orthogonal, so what earlier components explain comes off anew before each component.
            for a, b in zip(us.T[:comp], vs.T[:comp]):
                s = s - (a @ s @ b) * np.outer(a, b)
        v = np.linalg.svd(s, full_matrices=False)[2][0]
        u = np.zeros(p)
        for _ in range(max_iter):
            last_u, last_v = u, v
            u = l1_unit(s @ v, b1, paper)
            v = l1_unit(s.T @ u, b2, paper)
            if max(np.linalg.norm(u - last_u), np.linalg.norm(v - last_v)) < tol:
                break
        us[:, comp], vs[:, comp] = u, v
        if bound != "fraction":
            s = s - np.outer(u, u @ s)
            s = s - np.outer(s @ v, v)
    return fix_signs(us, vs)


def pair_correlations(sxx: np.ndarray, sxy: np.ndarray, syy: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of x a_k with y b_k per component; NaN where a variate is constant."""
    num = np.einsum("ik,ik->k", a, sxy @ b)
    va = np.einsum("ik,ik->k", a, sxx @ a)
    vb = np.einsum("ik,ik->k", b, syy @ b)
    den = np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))
    return np.where(den > 0, num / np.where(den > 0, den, 1.0), np.nan)


def loadings(sxx: np.ndarray, a: np.ndarray, n: float, inflate: bool = False) -> np.ndarray:
    """Correlation of every feature with every variate; `inflate` multiplies by n/(n-1)."""
    if n < 3:
        return np.zeros((sxx.shape[0], a.shape[1]))
    sd = np.sqrt(np.maximum(np.diag(sxx), 0))
    va = np.sqrt(np.maximum(np.einsum("ik,ik->k", a, sxx @ a), 0))
    out = (sxx @ a) / np.where(sd == 0, 1.0, sd)[:, None] / np.where(va == 0, 1.0, va)
    return out * n / (n - 1) if inflate else out


@dataclass
class Fit:
    """Row maps and diagnostics of one fitted configuration."""

    wx: np.ndarray  # z -> variates of view x
    wy: np.ndarray
    a: np.ndarray  # weights on the prepared (and reduced) features
    b: np.ndarray
    r_train: np.ndarray
    eigenvalues: np.ndarray | None = None
    x_components: np.ndarray | None = None


class PairModel:
    """Train-only preparation and reduction of both views from one moment matrix.

    `reduced` says that view x already holds component scores: they are neither scaled
    nor reduced again, so their order and their variances keep their meaning.
    """

    def __init__(self, m: np.ndarray, layout, max_dim: int | None = None, residualize: bool = True, reduced: bool = False):
        w = linear_prep(m, layout, residualize)
        p = layout.p
        if reduced:
            w[:, :p] = linear_prep(m, layout, residualize, standardize=False)[:, :p]
            max_dim = None
        self.n, _, cov = covariance(m, w)
        self.px, self.py = w[:, :p], w[:, p:]
        self.eigenvalues = self.components = None
        if max_dim is not None:
            k = max(1, min(max_dim, p, int(self.n) - 1))
            self.eigenvalues, self.components = pca(cov[:p, :p], k)
            self.px = self.px @ self.components
        self.cov = covariance(m, np.hstack([self.px, self.py]))[2]

    def blocks(self, cov: np.ndarray, dim: int):
        kx = self.px.shape[1]
        d = min(dim, kx)
        return cov[:d, :d], cov[:d, kx:], cov[kx:, kx:]

    def fit(self, method: str, dim: int, k: int, c1: float = 1.0, c2: float = 1.0, **options) -> Fit:
        sxx, sxy, syy = self.blocks(self.cov, dim)
        k = min(k, sxx.shape[0], syy.shape[0])
        if method == "cca":
            a, b, _ = cca(sxx, sxy, syy, k)
        elif method == "scca":
            a, b = scca(sxy, k, c1, c2, **options)
        else:
            raise ValueError(f"unknown method: {method}")
        d = sxx.shape[0]
        r = pair_correlations(sxx, sxy, syy, a, b)
        comps = None if self.components is None else self.components[:, :d]
        return Fit(self.px[:, :d] @ a, self.py @ b, a, b, r, self.eigenvalues, comps)

    def score(self, fit: Fit, m: np.ndarray) -> np.ndarray:
        """Component correlations of a fitted model on the rows behind another moment matrix."""
        k = fit.wx.shape[1]
        cov = covariance(m, np.hstack([fit.wx, fit.wy]))[2]
        eye = np.eye(k)
        return pair_correlations(cov[:k, :k], cov[:k, k:], cov[k:, k:], eye, eye)
