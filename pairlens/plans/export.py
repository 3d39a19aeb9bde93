"""Refit of a chosen configuration with everything needed to read it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators import solve
from pairlens.operators.interpret import edge_to_node, gene_weight_rollup, rank_nodes, topk_features
from pairlens.operators.linear import canonical_variates
from pairlens.operators.moments import Layout, collect_moments
from pairlens.plans.coupling import HOLDOUT, split_moments


def _long(spark, mat: np.ndarray, names: Sequence[str] | None, prefix: str, value: str) -> DataFrame:
    labels = list(names) if names is not None else [f"{prefix}_{i}" for i in range(mat.shape[0])]
    if len(labels) != mat.shape[0]:
        raise ValueError(f"{len(labels)} names for {mat.shape[0]} features")
    rows = [(i, labels[i], c, float(mat[i, c])) for i in range(mat.shape[0]) for c in range(mat.shape[1])]
    return spark.createDataFrame(rows, f"position int, feature string, component int, {value} double")


def best_fit_export(
    df: DataFrame,
    z: Column,
    layout: Layout,
    method: str,
    dim: int,
    c1: float | None = None,
    c2: float | None = None,
    k: int = 1,
    keep: Sequence[str] = ("subject_id", "fold"),
    x_names: Sequence[str] | None = None,
    y_names: Sequence[str] | None = None,
    inflate: bool = False,
) -> dict[str, DataFrame]:
    """Variates, mapped weights, loadings and correlations of one configuration.

    Rows with fold -1 are the holdout; the model is fitted on the others.
    """
    spark = df.sparkSession
    mats = collect_moments(split_moments(df, z), ["fold"])
    train = sum(m for (fold,), m in mats.items() if fold != HOLDOUT)
    held = mats.get((HOLDOUT,))
    model = solve.PairModel(train, layout, dim)
    fit = model.fit(method, dim, k, 1.0 if c1 is None else c1, 1.0 if c2 is None else c2)
    kx = model.px.shape[1]
    load = solve.loadings(model.cov[kx:, kx:], fit.b, model.n, inflate)
    r_hold = model.score(fit, held) if held is not None else np.full(fit.r_train.shape, np.nan)
    r_rows = [(i, float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(fit.r_train, r_hold))]
    return {
        "variates": canonical_variates(df, z, fit, keep),
        "x_weights": _long(spark, fit.x_components @ fit.a, x_names, "gene", "weight"),
        "y_weights": _long(spark, fit.b, y_names, "brain", "weight"),
        "y_loadings": _long(spark, load, y_names, "brain", "weight"),
        "correlations": spark.createDataFrame(r_rows, "component int, r_train double, r_holdout double"),
    }


def top_loadings(export: dict[str, DataFrame], k: int = 30) -> DataFrame:
    return topk_features(export["y_loadings"], ["component"], k)


def gene_level(export: dict[str, DataFrame], block: Column, k: int = 30) -> DataFrame:
    """Largest feature blocks by L2 norm of the mapped first-component weights."""
    weights = export["x_weights"].filter("component = 0").withColumn("gene", block)
    return gene_weight_rollup(weights).orderBy(F.col("l2").desc(), F.col("gene").desc()).limit(k)


def node_weight_report(edge_weights: DataFrame) -> DataFrame:
    """Edge weights of the first component as ranked nodes."""
    return rank_nodes(edge_to_node(edge_weights))


def best_by_holdout(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best configuration by holdout score, flagged: the choice sees the holdout."""
    from pairlens.operators.reports import best_config

    return best_config(results, keys, by="r_holdout").withColumn("selected_on_holdout", F.lit(True))
