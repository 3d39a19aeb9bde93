"""Fold-wise sparse canonical analysis with a final interpretable fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from pairlens.operators import solve
from pairlens.operators.interpret import topk_features
from pairlens.operators.moments import Layout, collect_moments
from pairlens.plans.coupling import HOLDOUT, split_moments
from pairlens.plans.export import _long


def interpretable_scca(
    df: DataFrame, z: Column, layout: Layout, k: int, c1: float = 0.3, c2: float = 0.3, tol: float = 1e-3, top: int = 10, **options
) -> dict[str, DataFrame]:
    """Per-fold correlations and sparsity, then weights, loadings and top features of the training fit."""
    spark = df.sparkSession
    mats = {fold: m for (fold,), m in collect_moments(split_moments(df, z), ["fold"]).items()}
    train = sum(m for fold, m in mats.items() if fold != HOLDOUT)
    rows = []
    for fold in sorted(mats):
        m = train if fold == HOLDOUT else train - mats[fold]
        model = solve.PairModel(m, layout)
        fit = model.fit("scca", layout.p, k, c1, c2, **options)
        r_eval = model.score(fit, mats[fold])
        rows += [
            (fold, c, float(fit.r_train[c]), float(np.nan_to_num(r_eval[c])),
             float((np.abs(fit.a[:, c]) < tol).mean()), float((np.abs(fit.b[:, c]) < tol).mean()))
            for c in range(fit.a.shape[1])
        ]
    model = solve.PairModel(train, layout)
    fit = model.fit("scca", layout.p, k, c1, c2, **options)
    p = layout.p
    x_load = solve.loadings(model.cov[:p, :p], fit.a, model.n)
    y_load = solve.loadings(model.cov[p:, p:], fit.b, model.n)
    out = {
        "folds": spark.createDataFrame(
            rows, "fold int, component int, r_train double, r_val double, sparsity_x double, sparsity_y double"
        ),
        "x_weights": _long(spark, fit.a, None, "gene", "weight"),
        "y_weights": _long(spark, fit.b, None, "brain", "weight"),
        "x_loadings": _long(spark, x_load, None, "gene", "weight"),
        "y_loadings": _long(spark, y_load, None, "brain", "weight"),
    }
    out |= {f"top_{n}": topk_features(out[n], ["component"], top) for n in ("x_weights", "y_weights", "x_loadings", "y_loadings")}
    return out
