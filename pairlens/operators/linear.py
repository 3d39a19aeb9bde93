"""Row-wise linear maps and the estimators that end in one.

`project` applies a fitted matrix to z in Arrow batches. Residualizing, scaling, PCA
scores and canonical variates differ only in the matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators import solve
from pairlens.operators.decode import key_groups, matrix
from pairlens.operators.moments import MAX_DIM, Layout, collect_moments, moments

MAX_MAP_CELLS = 64_000_000  # 512 MB of doubles per worker


def project(df: DataFrame, z: str | Column, maps: dict[str, np.ndarray], keep: Sequence[str], key: str | None = None) -> DataFrame:
    """Add one array column per entry of `maps`, holding z times the matrix.

    With `key`, each matrix value is a dict from the key value of the row to a matrix
    (for example one map per fold). Matrices are features-sized; the size is checked.
    """
    keep = list(keep)
    cells = sum(sum(m.size for m in v.values()) if key else v.size for v in maps.values())
    if cells > MAX_MAP_CELLS:
        raise ValueError(f"linear map of {cells} cells is too large to ship to every task; reduce the features first")
    zcol = F.col(z) if isinstance(z, str) else z
    shared = df.sparkSession.sparkContext.broadcast(maps)
    names = list(maps)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])

    def as_lists(values):
        offsets = np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))

    def run(batches):
        local = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            mat = matrix(batch.column("_z"))
            arrays = [batch.column(c) for c in keep]
            if key is None:
                outs = [mat @ local[n] for n in names]
            else:
                groups = key_groups([batch.column("_k")], batch.num_rows)
                outs = []
                for n in names:
                    width = next(iter(local[n].values())).shape[1]
                    out = np.full((batch.num_rows, width), np.nan)
                    for (value,), rows in groups:
                        if value in local[n]:
                            out[rows] = mat[rows] @ local[n][value]
                    outs.append(out)
            arrays += [as_lists(np.ascontiguousarray(o)) for o in outs]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + names)

    cols = [*keep, zcol.cast("array<double>").alias("_z")] + ([F.col(key).alias("_k")] if key else [])
    return df.select(*cols).mapInArrow(run, schema)


def moment_matrix(df: DataFrame, z: Column | str, where: Column | None = None) -> np.ndarray:
    """Moment matrix of all rows (or those matching `where`) on the driver."""
    rows = df.filter(where) if where is not None else df
    got = collect_moments(moments(rows, [], z))
    if not got:
        raise ValueError("no rows to fit on")
    return got[()]


def prepare_views(
    df: DataFrame,
    z: Column,
    layout: Layout,
    keep: Sequence[str],
    train: Column | None = None,
    residualize: bool = True,
    standardize: bool = True,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Residualized and/or scaled views; fitted on the rows where `train` holds, applied to all."""
    w = solve.linear_prep(moment_matrix(df, z, train), layout, residualize, standardize)
    maps = {}
    if layout.p:
        maps[x] = w[:, : layout.p]
    if layout.q:
        maps[y] = w[:, layout.p :]
    return project(df, z, maps, keep)


def pca_scores(
    df: DataFrame, z: Column, layout: Layout, k: int, keep: Sequence[str], train: Column | None = None, out: str = "pcs",
    residualize: bool = False, standardize: bool = True,
) -> tuple[DataFrame, np.ndarray, float]:
    """Scores of the first view, eigenvalues and total variance (exact, through the moment matrix)."""
    if layout.p > MAX_DIM:
        raise ValueError("too many features for an exact PCA; use block_pca")
    m = moment_matrix(df, z, train)
    w = solve.linear_prep(m, layout, residualize, standardize)[:, : layout.p]
    n, mean, cov = solve.covariance(m, w)
    values, comps = solve.pca(cov, min(k, int(n)))
    shifted = w @ comps
    shifted[0, :] -= mean @ comps
    return project(df, z, {out: shifted}, keep), values, float(np.trace(cov))


def explained_variance(values: np.ndarray, total: float) -> tuple[int, float]:
    return len(values), float(values.sum() / total) if total > 0 else 0.0


def canonical_fit(
    df: DataFrame,
    z: Column,
    layout: Layout,
    k: int,
    method: str = "cca",
    c1: float = 1.0,
    c2: float = 1.0,
    pca_dim: int | None = None,
    train: Column | None = None,
    residualize: bool = True,
    **options,
) -> tuple[solve.PairModel, solve.Fit]:
    """Fit (S)CCA on the rows where `train` holds from one moment pass."""
    model = solve.PairModel(moment_matrix(df, z, train), layout, pca_dim, residualize)
    return model, model.fit(method, pca_dim or layout.p, k, c1, c2, **options)


def canonical_variates(df: DataFrame, z: Column, fit: solve.Fit, keep: Sequence[str]) -> DataFrame:
    """Row scores `u` and `v` of both views."""
    return project(df, z, {"u": fit.wx, "v": fit.wy}, keep)


def variate_correlations(variates: DataFrame, keys: Sequence[str] = (), u: str = "u", v: str = "v") -> DataFrame:
    """Pearson correlation per component over a variates table; NULL when a variate is constant."""
    keys = list(keys)
    pairs = variates.select(*keys, F.posexplode(F.arrays_zip(F.col(u).alias("a"), F.col(v).alias("b"))).alias("component", "ab"))
    pairs = pairs.select(*keys, "component", F.col("ab.a").alias("a"), F.col("ab.b").alias("b"))
    ok = (F.min("a") < F.max("a")) & (F.min("b") < F.max("b"))
    stats = pairs.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("n"), F.when(ok, F.covar_pop("a", "b") / (F.stddev_pop("a") * F.stddev_pop("b"))).alias("r")
    )
    return stats
