"""Cross-validated classifiers over linear representations.

Residualizing, scaling, PCA and canonical variates are linear in z = [1, cov, x, y],
so a representation of a fold is a matrix W and a logistic model on it is one vector
in z. All representations and folds are therefore fitted together: every Newton
iteration is one pass over the rows, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import solve
from pairlens.operators.decode import matrix
from pairlens.operators.linear import MAX_MAP_CELLS, project
from pairlens.operators.moments import few_tasks, matrix_from_cells, sum_rows


HOLDOUT = -1  # fold number of rows that no model may train on


@dataclass
class FoldModel:
    """One classifier: representation `name`, tested on `fold`, trained on the other non-holdout folds."""

    name: str
    fold: int
    w: np.ndarray  # z -> scaled features, first column the constant 1
    class_weight: tuple[float, float]
    beta: np.ndarray = field(default=None)

    @property
    def direction(self) -> np.ndarray:
        return self.w @ self.beta


def scaled_map(m_train: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Append train-only scaling to a map and put the intercept column first."""
    n, mean, cov = solve.covariance(m_train, w)
    var = np.diag(cov)
    sd = np.where(var > solve.ZERO_VARIANCE, np.sqrt(np.maximum(var, 0)), 1.0)
    out = w / sd
    out[0, :] -= mean / sd
    ones = np.zeros((w.shape[0], 1))
    ones[0, 0] = 1.0
    return np.hstack([ones, out])


def balanced_weights(n: float, n_pos: float) -> tuple[float, float]:
    """n / (2 * class size) for class 0 and class 1."""
    neg = n - n_pos
    return (n / (2 * neg) if neg > 0 else 0.0, n / (2 * n_pos) if n_pos > 0 else 0.0)


def training_rows(batch: pa.RecordBatch, test_fold: int) -> np.ndarray:
    """Which rows a model tested on `test_fold` trains on: those of other folds, but the holdout.

    Where z itself differs by model, as with components fitted per fold, a column `subset` says whose z a row has: the model's test fold.
    """
    fold = batch.column("fold").to_numpy(zero_copy_only=False)
    rows = (fold != test_fold) & (fold != HOLDOUT)
    if "subset" in batch.schema.names:
        rows &= batch.column("subset").to_numpy(zero_copy_only=False) == test_fold
    return rows


def _newton_pass(df: DataFrame, models: Sequence[FoldModel]) -> dict[int, np.ndarray]:
    """[Hessian | gradient] of every model from one pass over (fold, y, z) rows."""
    specs = [(i, m.fold, m.w, m.beta, m.class_weight) for i, m in enumerate(models)]
    if sum(m.w.size for m in models) > MAX_MAP_CELLS:
        raise ValueError("too many model cells to ship to every task; fit fewer representations at once")
    shared = df.sparkSession.sparkContext.broadcast(specs)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = matrix(batch.column("z"), finite=True)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            for i, test_fold, w, beta, (w0, w1) in shared.value:
                rows = training_rows(batch, test_fold)
                if not rows.any():
                    continue
                f, t = z[rows] @ w, y[rows]
                p = 1.0 / (1.0 + np.exp(-np.clip(f @ beta, -500, 500)))
                weight = np.where(t == 1, w1, w0)
                hess = (f * (weight * p * (1 - p))[:, None]).T @ f
                grad = f.T @ (weight * (t - p))
                block = np.hstack([hess, grad[:, None]])
                sums[i] = sums[i] + block if i in sums else block
        for i, block in sums.items():
            d = block.shape[0]
            tails = [block[r, r:] for r in range(d)]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tails])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i] * d, type=pa.int32()),
                    pa.array(np.arange(d, dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tails))),
                ],
                names=["model", "i", "tail"],
            )

    keep = [c for c in ("subset", "fold", "y", "z") if c in df.columns]
    partial = few_tasks(df.select(*keep)).mapInArrow(run, "model int, i int, tail array<double>")
    table = sum_rows(partial, ["model"]).toPandas()  # features x features per model
    return {
        int(i): matrix_from_cells(part["i"], part["j"], part["s"], int(part["j"].max()) + 1)
        for i, part in table.groupby("model")
    }


def fit_logistic(df: DataFrame, models: Sequence[FoldModel], penalty: float = 1.0, max_iter: int = 100, tol: float = 1e-7) -> list[FoldModel]:
    """L2-penalized logistic regressions (intercept free) for all models at once.

    `df` holds (fold, y, z), and `subset` where z differs by model, and should be persisted. Each model is trained on the rows
    outside its fold and outside the holdout. Steps below `tol` end a fit; models that still move after
    `max_iter` passes are an error.
    """
    for m in models:
        m.beta = np.zeros(m.w.shape[1])
    active = list(models)
    for _ in range(max_iter):
        sums = _newton_pass(df, active)
        still = []
        for i, m in enumerate(active):
            d = m.w.shape[1]
            ridge = np.full(d, penalty)
            ridge[0] = 0.0
            hess = sums[i][:d, :d] + np.diag(ridge) + 1e-12 * np.eye(d)
            step = np.linalg.solve(hess, sums[i][:d, d] - ridge * m.beta)
            length = np.abs(step).max()
            m.beta = m.beta + step * min(1.0, 5.0 / max(length, 1e-300))
            if length > tol:
                still.append(m)
        active = still
        if not active:
            break
    else:
        raise RuntimeError(f"{len(active)} of {len(models)} logistic models have not converged in {max_iter} passes")
    return list(models)


def score_models(df: DataFrame, models: Sequence[FoldModel], keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Out-of-fold probabilities in long form (keep..., model, score, yhat), one pass for all models."""
    names = sorted({m.name for m in models})
    by_fold: dict = {}
    for fold in sorted({m.fold for m in models}):
        cols = {m.name: m.direction for m in models if m.fold == fold}
        by_fold[fold] = np.column_stack([cols[n] for n in names])
    scored = project(df.filter(F.col("fold").isin(list(by_fold))), "z", {"eta": by_fold}, [*keep, "fold"], key="fold")
    entries = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("model"), F.col("eta"))
    long = scored.select(*keep, "fold", F.inline(entries)).withColumnRenamed("eta", "_eta")
    score = 1 / (1 + F.exp(-F.col("_eta")))
    return long.select(*keep, "fold", "model", score.alias("score"), (score > threshold).cast("int").alias("yhat"))


def fit_score_mlp(
    df: DataFrame,
    models: Sequence[FoldModel],
    keep: Sequence[str],
    hidden: Sequence[int] = (64, 32),
    max_iter: int = 50,
    seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """Two-hidden-layer perceptrons (Spark ML) on the same representations.

    Fits run as concurrent Spark jobs, with sigmoid units and L-BFGS; `mlp.fit_mlps` has ReLU units and Adam.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def one(m: FoldModel) -> DataFrame:
        rep = project(df, "z", {"f": m.w[:, 1:]}, [*keep, "fold", "y"] if "y" not in keep else [*keep, "fold"])
        rep = rep.withColumn("features", array_to_vector("f")).withColumn("label", F.col("y").cast("double"))
        net = MultilayerPerceptronClassifier(
            layers=[m.w.shape[1] - 1, *hidden, 2], maxIter=max_iter, seed=seed, featuresCol="features", labelCol="label"
        )
        fitted = net.fit(rep.filter(~F.col("fold").isin(m.fold, HOLDOUT)).select("features", "label"))
        test = fitted.transform(rep.filter(F.col("fold") == m.fold))
        score = F.element_at(vector_to_array("probability"), 2)
        return test.select(*keep, "fold", F.lit(m.name).alias("model"), score.alias("score"), (score > 0.5).cast("int").alias("yhat"))

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(one, models))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
