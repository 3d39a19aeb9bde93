"""Predictive suite: representations x classifiers, cross-validated and on a holdout."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators import solve
from pairlens.operators.classify import HOLDOUT, FoldModel, balanced_weights, fit_logistic, fit_score_mlp, scaled_map, score_models
from pairlens.operators.metrics import classification_metrics, confusion_matrix, fold_summary, ranking_metrics
from pairlens.operators.mlp import fit_mlps, score_mlps
from pairlens.operators.moments import Layout, collect_moments, moments
from pairlens.session import held

REPRESENTATIONS = ("gene_only", "fmri_only", "early_fusion", "cca_joint", "scca_joint")


def _rows(df: DataFrame, z: Column, keep: Sequence[str]) -> DataFrame:
    cols = list(dict.fromkeys([*keep, "fold", "y"]))
    return held(df.select(*cols, z.cast("array<double>").alias("z")))


def fold_matrices(rows: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Moment matrix and number of positives per fold, in one pass (the label rides along in z)."""
    z = F.concat("z", F.array(F.col("y").cast("double")))
    mats = {fold: m for (fold,), m in collect_moments(moments(rows, ["fold"], z), ["fold"]).items()}
    return {f: m[:-1, :-1] for f, m in mats.items()}, {f: float(m[0, -1]) for f, m in mats.items()}


def representation_map(
    name: str, m: np.ndarray, layout: Layout, pca_dim: int | None, k: int, c1: float, c2: float, base: np.ndarray | None = None
) -> np.ndarray:
    """Matrix from z to one representation, fitted on the rows behind `m`.

    `base` fixes the preparation (train-wide scope); by default it is refitted here.
    `joint` and `joint_mean` combine two score vectors as they are.
    """
    p = layout.p
    if name in ("joint", "joint_mean"):
        raw = np.eye(layout.dim)
        x, y = raw[:, layout.x], raw[:, layout.y]
        return np.hstack([x, y]) if name == "joint" else (x + y) / 2
    w = solve.linear_prep(m, layout) if base is None else base
    px, py = w[:, :p], w[:, p:]
    if base is None and pca_dim is not None:
        cov = solve.covariance(m, w)[2]
        px = px @ solve.pca(cov[:p, :p], min(pca_dim, p))[1]
    elif base is not None:
        px, py = base[:, : -layout.q], base[:, -layout.q :]
    kx = px.shape[1]
    if name == "gene_only":
        return px
    if name == "fmri_only":
        return py
    both = np.hstack([px, py])
    if name == "early_fusion":
        return both
    # Stage one sees features scaled on its own training rows.
    cov = solve.covariance(m, both)[2]
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-9, sd, 1.0)
    corr = cov / np.outer(sd, sd)
    k = min(k, kx, both.shape[1] - kx)
    if name == "cca_joint":
        a, b, _ = solve.cca(corr[:kx, :kx], corr[:kx, kx:], corr[kx:, kx:], k)
    elif name == "scca_joint":
        a, b = solve.scca(corr[:kx, kx:], k, c1, c2)
    else:
        raise ValueError(f"unknown representation: {name}")
    return np.hstack([(px / sd[:kx]) @ a, (py / sd[kx:]) @ b])


def build_models(
    mats: dict[int, np.ndarray], positives: dict[int, float], layout: Layout, representations: Sequence[str],
    pca_dim: int | None, k: int, c1: float, c2: float, scope: str = "fold", holdout: bool = True,
) -> list[FoldModel]:
    """One unfitted classifier per representation and fold. The holdout never enters a training part."""
    train_folds = [f for f in mats if f != HOLDOUT]
    base = None
    if scope == "train":
        m = sum(mats[f] for f in train_folds)
        w = solve.linear_prep(m, layout)
        base = w
        if pca_dim is not None:
            comps = solve.pca(solve.covariance(m, w)[2][: layout.p, : layout.p], min(pca_dim, layout.p))[1]
            base = np.hstack([w[:, : layout.p] @ comps, w[:, layout.p :]])
    elif scope != "fold":
        raise ValueError(f"scope must be fold or train, got {scope!r}")
    models = []
    for fold in sorted(mats):
        if fold == HOLDOUT and not holdout:
            continue
        used = [f for f in train_folds if f != fold]
        m, pos = sum(mats[f] for f in used), sum(positives[f] for f in used)
        for name in representations:
            w = representation_map(name, m, layout, pca_dim, k, c1, c2, base)
            models.append(FoldModel(name, fold, scaled_map(m, w), balanced_weights(m[0, 0], pos)))
    return models


def fitted_scores(rows: DataFrame, test: DataFrame, models: list[FoldModel], classifier: str, keep: Sequence[str], hidden, max_iter: int, seed: int) -> DataFrame:
    """Scores of every row of `test` by the model of its own fold, trained on `rows`."""
    if classifier == "logreg":
        return score_models(test, fit_logistic(rows, models), keep)
    if classifier == "mlp":
        return score_mlps(test, fit_mlps(rows, models, hidden, max_epochs=max_iter, seed=seed), keep)
    if classifier == "mlp_lbfgs":
        if "subset" in rows.columns:
            raise ValueError("mlp_lbfgs takes one representation for all folds")
        return fit_score_mlp(rows, models, keep, hidden, max_iter, seed)
    raise ValueError(f"unknown classifier: {classifier}")


def cross_validated_scores(
    df: DataFrame,
    z: Column,
    layout: Layout,
    representations: Sequence[str] = ("early_fusion",),
    classifiers: Sequence[str] = ("logreg",),
    keep: Sequence[str] = ("subject_id", "y"),
    pca_dim: int | None = None,
    k: int = 10,
    c1: float = 0.3,
    c2: float = 0.3,
    scope: str = "fold",
    holdout: bool = True,
    hidden: Sequence[int] = (64, 32),
    mlp_iter: int = 200,
    seed: int = 42,
) -> DataFrame:
    """Out-of-fold and holdout scores (keep..., fold, split, model, score, yhat).

    Classifiers: "logreg", "mlp" (ReLU, Adam, early stopping) and "mlp_lbfgs" (Spark ML).
    """
    rows = _rows(df, z, keep)
    mats, positives = fold_matrices(rows)
    parts = []
    for classifier in classifiers:
        models = build_models(mats, positives, layout, representations, pca_dim, k, c1, c2, scope, holdout)
        got = fitted_scores(rows, rows, models, classifier, keep, hidden, mlp_iter, seed)
        parts.append(got.withColumn("model", F.concat(F.col("model"), F.lit(f"_{classifier}"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("split", F.when(F.col("fold") == HOLDOUT, "holdout").otherwise("cv"))


def suite_metrics(scores: DataFrame) -> DataFrame:
    """AUC and average precision per model on pooled out-of-fold scores and on the holdout."""
    return ranking_metrics(scores, ["model", "split"])


def stage_two_metrics(scores: DataFrame) -> DataFrame:
    """Fold means and sds of AUC, accuracy, precision, recall and F1 with the pooled confusion matrix."""
    per_fold = ranking_metrics(scores, ["model", "fold"], single_class_auc=0.5).join(
        classification_metrics(scores, ["model", "fold"]), ["model", "fold"]
    )
    summary = fold_summary(per_fold, ["model"], ["auc", "accuracy", "precision", "recall", "f1"])
    return summary.join(confusion_matrix(scores, ["model"]), "model")


def predictive_suite(df: DataFrame, z: Column, layout: Layout, **options) -> DataFrame:
    """Five representations with the given classifiers: CV on the training part, one look at the holdout."""
    options.setdefault("representations", REPRESENTATIONS)
    return suite_metrics(cross_validated_scores(df, z, layout, **options))
