"""Multilayer perceptrons on linear representations, all of them trained together.

ReLU layers and a logistic output, Adam on full-batch gradients: an epoch is one pass over the rows, in which every task adds up the gradients of
all networks on its rows; only gradients travel. A part of the training rows is held out of every network's gradients, and a
network stops, with its best weights, once the loss there no longer falls.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.classify import HOLDOUT, FoldModel, training_rows
from pairlens.operators.decode import matrix
from pairlens.operators.linear import MAX_MAP_CELLS
from pairlens.operators.moments import few_tasks, sum_rows

CHUNK = 1024  # gradient values of a row of partial sums


@dataclass
class Net:
    """One network on the scaled features of a `FoldModel`; `history` has (training loss, held-out loss) per epoch."""

    model: FoldModel
    sizes: tuple[int, ...]
    theta: np.ndarray
    history: list[tuple[float, float]] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.model.name

    @property
    def fold(self) -> int:
        return self.model.fold


def layers(theta: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, biases) of every layer as views of the flat parameters."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def new_net(model: FoldModel, hidden: Sequence[int], seed: int) -> Net:
    """Uniform weights within the root of 6 / (inputs + outputs) of a layer, and biases alike."""
    sizes = (model.w.shape[1] - 1, *hidden, 1)
    rng = np.random.default_rng([seed, model.fold + 2, *map(ord, model.name)])
    parts = [rng.uniform(-1, 1, a * b + b) * np.sqrt(6 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    return Net(model, sizes, np.concatenate(parts))


def forward(theta: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer, the inputs first; the last are probabilities."""
    out = [x]
    parts = layers(theta, sizes)
    for k, (w, b) in enumerate(parts):
        v = out[-1] @ w + b
        out.append(np.maximum(v, 0) if k < len(parts) - 1 else 1 / (1 + np.exp(-np.clip(v, -500, 500))))
    return out


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    """Sum of the log losses."""
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def gradient(theta: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum over rows of the gradient of the log loss, and of the loss."""
    acts = forward(theta, sizes, x)
    parts = layers(theta, sizes)
    out = np.zeros_like(theta)
    slots = layers(out, sizes)
    delta = acts[-1] - y[:, None]
    for k in range(len(parts) - 1, -1, -1):
        slots[k][0][...] = acts[k].T @ delta
        slots[k][1][...] = delta.sum(axis=0)
        if k:
            delta = (delta @ parts[k][0].T) * (acts[k] > 0)
    return out, log_loss(acts[-1][:, 0], y)


def penalized(theta: np.ndarray, sizes: Sequence[int], alpha: float) -> np.ndarray:
    """Gradient of alpha / 2 times the squared weights; biases are free."""
    out = np.zeros_like(theta)
    for (w, _), (slot, _) in zip(layers(theta, sizes), layers(out, sizes)):
        slot[...] = alpha * w
    return out


class Adam:
    """Adam's running moments for one network."""

    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        """What to add to the parameters."""
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return -self.rate * m / (np.sqrt(v) + 1e-8)


def epoch_sums(df: DataFrame, nets: Sequence[Net]) -> list[np.ndarray]:
    """Per network: gradient sum over its training rows, then their loss and number, and loss and number of its held-out rows. One pass."""
    specs = [(i, net.fold, net.model.w[:, 1:], net.sizes, net.theta) for i, net in enumerate(nets)]
    if sum(s[2].size + s[4].size for s in specs) > MAX_MAP_CELLS:
        raise ValueError("too many model cells to ship to every task; fit fewer networks at once")
    shared = df.sparkSession.sparkContext.broadcast(specs)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = matrix(batch.column("z"), finite=True)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            aside = batch.column("aside").to_numpy(zero_copy_only=False)
            for i, fold, w, sizes, theta in shared.value:
                rows = training_rows(batch, fold)
                fit, held = rows & ~aside, rows & aside
                grad, loss = gradient(theta, sizes, z[fit] @ w, y[fit])
                away = log_loss(forward(theta, sizes, z[held] @ w)[-1][:, 0], y[held])
                part = np.concatenate([grad, [loss, fit.sum(), away, held.sum()]])
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            cuts = [part[a : a + CHUNK] for a in range(0, len(part), CHUNK)]
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int32)
            zero = pa.array(np.zeros(len(cuts), np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cuts), i, np.int32)), pa.array(np.arange(len(cuts), dtype=np.int32)), zero, pa.ListArray.from_arrays(pa.array(offsets), pa.array(part))],
                names=["net", "chunk", "i", "tail"],
            )

    keep = [c for c in ("subset", "fold", "y", "z", "aside") if c in df.columns]
    partial = few_tasks(df.select(*keep)).mapInArrow(run, "net int, chunk int, i int, tail array<double>")
    table = sum_rows(partial, ["net", "chunk"]).toPandas()  # the parameters of every network
    out = [np.zeros(len(net.theta) + 4) for net in nets]
    for net, part in table.groupby("net"):
        out[net][part["chunk"].to_numpy() * CHUNK + part["j"].to_numpy()] = part["s"].to_numpy()
    return out


def fit_mlps(
    df: DataFrame,
    models: Sequence[FoldModel],
    hidden: Sequence[int] = (64, 32),
    rate: float = 0.01,
    alpha: float = 1e-4,
    max_epochs: int = 200,
    validation: float = 0.1,
    patience: int = 10,
    tol: float = 1e-4,
    seed: int = 42,
) -> list[Net]:
    """Networks for all models at once.

    `df` holds (fold, y, z), with `subset` where representations differ by model (see `classify.training_rows`), and should be persisted. A hash of the row puts
    `validation` of the training rows aside. A network stops when its loss there has not fallen by `tol` in `patience` epochs, and keeps its best weights;
    with no row aside the training loss decides. `max_epochs` ends the others.
    """
    rows = df.withColumn("aside", F.pmod(F.xxhash64(F.lit(seed), "z"), F.lit(1_000_000)) < int(validation * 1_000_000))
    nets = [new_net(m, hidden, seed) for m in models]
    rules = {id(net): Adam(len(net.theta), rate) for net in nets}
    best = {id(net): (np.inf, 0, net.theta) for net in nets}
    active = list(nets)
    for epoch in range(max_epochs + 1):
        still = []
        for net, part in zip(active, epoch_sums(rows, active)):
            grad, (loss, n, away, m) = part[:-4], part[-4:]
            if not n:
                raise ValueError(f"no training rows for {net.name} on fold {net.fold}")
            net.history.append((loss / n, away / m if m else loss / n))
            least, since, theta = best[id(net)]
            now = net.history[-1][1]
            best[id(net)] = (now, epoch, net.theta) if now < least - tol else (least, since, theta)
            if epoch - best[id(net)][1] >= patience or epoch == max_epochs:
                net.theta = best[id(net)][2]
                continue
            net.theta = net.theta + rules[id(net)].step(grad / n + penalized(net.theta, net.sizes, alpha / n))
            still.append(net)
        active = still
        if not active:
            break
    return nets


def score_mlps(df: DataFrame, nets: Sequence[Net], keep: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Out-of-fold probabilities (keep..., fold, model, score, yhat): every row by the networks of its own fold."""
    keep = list(keep)
    specs = [(net.name, net.fold, net.model.w[:, 1:], net.sizes, net.theta) for net in nets]
    shared = df.sparkSession.sparkContext.broadcast(specs)
    names = sorted({net.name for net in nets})
    cols = [*keep, "fold"] if "fold" not in keep else keep
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches):
        for batch in batches:
            z = matrix(batch.column("z"))
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for name in names:
                score, known = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
                for other, f, w, sizes, theta in shared.value:
                    own = fold == f
                    if other == name and own.any():
                        score[own], known[own] = forward(theta, sizes, z[own] @ w)[-1][:, 0], True
                at = pa.array(np.flatnonzero(known))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in cols), pa.array([name] * len(at)), pa.array(score[known])], names=[*cols, "model", "score"])

    got = df.select(*cols, "z").mapInArrow(run, f"{kinds}, model string, score double")
    return got.withColumn("yhat", (F.col("score") > threshold).cast("int"))
