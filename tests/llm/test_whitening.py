"""Whitening against NumPy's eigenvectors, and its rank-one updates."""

import numpy as np
import pytest
from fixtures import rows_of
from pyspark.sql import functions as F

from pairlens.llm import whitening
from pairlens.llm.arrays import floors
from pairlens.llm.queries import QUERIES
from pairlens.llm.whitening import Spectrum, rank_one, secular_roots, whiten


def updated(d, u, rho):
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(len(d), len(d))))[0]
    d = np.sort(np.asarray(d, float))
    values, vectors = rank_one(d, q, q @ np.asarray(u, float), rho)
    want = q @ np.diag(d) @ q.T + rho * np.outer(q @ u, q @ u)
    scale = max(np.abs(want).max(), 1e-300)
    assert np.abs(vectors @ np.diag(values) @ vectors.T - want).max() < 1e-10 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(d))).max() < 1e-12
    assert (np.diff(values) >= 0).all()
    return values


@pytest.mark.parametrize(
    ("d", "u", "rho"),
    [
        (np.arange(8.0), np.ones(8), 2.0),
        (np.zeros(6), np.arange(6.0), 1.0),  # all equal: all but one deflate
        ([1, 1, 1, 2, 2, 5], [1, 2, 3, 4, 5, 6], 0.5),
        ([1, 1 + 1e-15, 1 + 3e-15, 2], [1, 1, 1, 1], 1.0),
        ([0, 1, 2, 3], [0, 1, 0, 1], 1.0),  # no part in two directions
        ([0, 1, 2, 3], [0, 0, 0, 0], 1.0),
        ([0, 1, 2, 3], [1, 1e-12, 1e-9, 1], 1e-3),
        (np.logspace(-12, 6, 10), np.ones(10), 1.0),
        ([0.0], [3.0], 2.0),
    ],
)
def test_rank_one_update(d, u, rho):
    updated(d, np.asarray(u, float), rho)


def test_roots_lie_between_the_poles():
    d, weight = np.array([0.0, 1.0, 1.0 + 1e-9, 4.0]), np.array([1e-8, 1.0, 1e-3, 2.0])
    gaps, x = secular_roots(d, weight)
    root = d[:, None] - (gaps - x[:, None]).T
    assert np.allclose(root, root[0], atol=1e-12)
    assert (root[0] > d).all() and (root[0][:-1] < d[1:]).all()


def test_spectrum_of_parts_is_that_of_all():
    rows = np.floor(np.random.default_rng(2).normal(size=(300, 9)) @ np.random.default_rng(3).normal(size=(9, 9)) * 30).astype(int)
    rows[:, 4] = rows[:, 5]
    whole, parts = Spectrum.empty(9), Spectrum.empty(9)
    whole.add(rows)
    for part in np.array_split(rows, [0, 1, 40, 200]):
        other = Spectrum.empty(9)
        other.add(part)
        parts.merge(other)
    scatter = np.cov(rows.T, bias=True) * len(rows)
    for s in (whole, parts, Spectrum.of(parts.record())):
        assert s.n == 300 and (s.sums == rows.sum(axis=0)).all()
        assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, scatter, rtol=0, atol=1e-9 * np.abs(scatter).max())


def expected(x, k):
    x = np.asarray(x, np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - sums) ** 2).sum(axis=1), centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def same_up_to_sign(got, want):
    sign = np.sign((got * want).sum(axis=0))
    return np.abs(got * sign - want).max()


@pytest.mark.parametrize("shift", [0, 1000000])
def test_equals_numpy(spark, shift, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(400, 10)) * np.arange(1, 11) * 40).astype(int) + shift
    data = [(k, [int(v) for v in row]) for k, row in enumerate(x)]
    out = whiten(spark.createDataFrame(data, "vec_id bigint, vec array<bigint>").repartition(7), 6, padding=shift).orderBy("vec_id").collect()
    n, deviation, white, explained = expected(x, 6)
    assert [r["vec_id"] for r in out] == list(range(400)) and {r["n"] for r in out} == {n}
    assert [r["deviation"] for r in out] == deviation.tolist()
    assert same_up_to_sign(np.array([r["whitened"] for r in out]), white) < 1e-9
    assert np.allclose(out[0]["explained"], explained, rtol=1e-12)
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-12


def test_awkward_rows(spark):
    rows = [(1, [1, 2, 3]), (2, None), (3, [1, None, 2]), (4, [5, 2]), (None, [1, 2, 3]), (1, [1, 2, 3]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<bigint>").withColumns({"n": F.lit("old"), "own": F.lit(8), "part": F.lit(9)})
    out = whiten(df, 32)
    assert set(out.columns) == {*df.columns, "whitened", "deviation", "explained", "identity_error"}
    x = np.array([[1, 2, 3], [5, 2, 0], [1, 2, 3], [1, 2, 3], [0, 0, 0]])
    assert rows_of(out, "vec_id", "deviation", "own") == sorted([(i, int(s), 8) for i, s in zip((1, 4, None, 1, 6), ((5 * x - x.sum(axis=0)) ** 2).sum(axis=1))], key=repr)
    got = out.collect()
    # Three different points span two directions: the third component has no variance.
    assert all(r["whitened"][2] is None and None not in r["whitened"][:2] and r["explained"][2] == 0 for r in got)
    assert got[0]["identity_error"] < 1e-12 and abs(sum(got[0]["explained"]) - 1) < 1e-12


def test_degenerate_tables(spark):
    kind = "vec_id bigint, vec array<bigint>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    one = whiten(spark.createDataFrame([(1, [3, 4])], kind)).collect()
    assert one[0]["whitened"] == [None, None] and one[0]["deviation"] == 0 and one[0]["explained"] == [0.0, 0.0]
    assert whiten(spark.createDataFrame([(1, []), (2, [])], kind)).collect()[0]["whitened"] == []
    large = whiten(spark.createDataFrame([(1, [4 * 10**9]), (2, [-4 * 10**9])], kind)).collect()
    assert [r["deviation"] for r in large] == [None, None] and abs(abs(large[0]["whitened"][0]) - 1) < 1e-12


def test_query_on_every_row(spark, duck):
    from conftest import SF

    out = QUERIES["op13_whitening"](spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select("vec_id", floors(F.col("embedding"), 64, 1000000)).collect()
    n, deviation, white, explained = expected([r[1] for r in raw], 32)
    rows = out.orderBy("vec_id", "component").collect()
    assert len(rows) == 32 * len(raw) and [r["vec_id"] for r in rows[::32]] == [r[0] for r in raw]
    assert [r["deviation"] for r in rows[::32]] == deviation.tolist() and {r["n"] for r in rows} == {n}
    assert same_up_to_sign(np.array([r["whitened"] for r in rows]).reshape(-1, 32), white) < 1e-8
    assert np.allclose([r["explained"] for r in rows[:32]], explained, rtol=1e-10)
    assert {r["identity_error"] < 1e-10 for r in rows} == {True}
