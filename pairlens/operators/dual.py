"""PCA of very wide views in the dual: one pass over feature blocks for any number of training sets.

With far fewer subjects than features, components follow from the subjects x subjects matrix K = Z Z' of the prepared features. A feature's scale comes
from the training rows, so K is the sum of x x' / s^2 over features, one weighted sum per training set; all of them are summed up in the same
pass over blocks. Covariates need no pass of their own: taking them off is a projection of K from both sides, and so is centring.
What a training set, a fold or a permuted group needs from there on are rows and columns of K.

A block (all subjects x the features of one block) is what a task looks at. Tiles of K are summed over tasks; only the task
that solves a training set holds its K. The number of subjects is therefore bounded (`MAX_SUBJECTS`); beyond it use `block_pca`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.decode import matrix
from pairlens.session import held

MAX_SUBJECTS = 8192  # K of this many is 0.5 GB
MAX_SIDE_CELLS = 32_000_000  # subjects x (covariates and second view) shipped to every task
TASK_CELLS = 64_000_000  # doubles of K that a task sums up at once; further training sets take another pass over the held blocks
TILE = 256
RANK = 1e-12  # eigenvalues below this share of the largest count as 0


@dataclass(frozen=True)
class Subset:
    """A training set and the rows that are scored with it: positions among the subjects."""

    key: int
    train: np.ndarray
    score: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.concatenate([self.train, self.score])


@dataclass
class Subjects:
    """The narrow side of all subjects in the order of their ids: covariates with intercept, second view, and further columns."""

    ids: np.ndarray
    c: np.ndarray
    y: np.ndarray
    columns: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def n(self) -> int:
        return len(self.ids)

    def positions(self, mask: np.ndarray) -> np.ndarray:
        return np.flatnonzero(mask)


def read_subjects(rows: DataFrame, c: str | None = "c", y: str | None = "b", columns: Sequence[str] = (), subject: str = "subject_id") -> Subjects:
    """At most MAX_SUBJECTS rows, one per subject, on the driver; more are an error."""
    picked = rows.select(F.col(subject).cast("string").alias("subject"), *([F.col(c).alias("_c")] if c else []), *([F.col(y).alias("_y")] if y else []), *columns)
    table = picked.limit(MAX_SUBJECTS + 1).toArrow().sort_by("subject")
    if table.num_rows > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects: their square is too large for a task; use block_pca")
    ids = np.array(table["subject"].to_pylist(), dtype=object)
    if len(set(ids.tolist())) < len(ids) or None in ids:
        raise ValueError("subjects must be there once, with an id")
    one = np.ones((len(ids), 1))

    def side(name: str) -> np.ndarray:
        return matrix(table[name].combine_chunks(), name, True) if table.num_rows else np.zeros((0, 0))

    covariates = np.hstack([one, side("_c")]) if c else one
    view = side("_y") if y else np.zeros((len(ids), 0))
    if covariates.size + view.size > MAX_SIDE_CELLS:
        raise ValueError(f"{covariates.size + view.size} values beside the blocks are too many to ship; reduce the second view first")
    return Subjects(ids, covariates, view, {name: table[name].to_numpy() for name in columns})


def dual_layout(blocks: DataFrame, subjects: Subjects, subject: str = "subject_id", block: str = "gene", embedding: str = "embedding") -> DataFrame:
    """(block, pos, x) with every block's rows together: the one shuffle of the data, kept for further passes. Other subjects are left out."""
    spark = blocks.sparkSession
    known = spark.createDataFrame([(str(s), k) for k, s in enumerate(subjects.ids)], "subject string, pos int")  # MAX_SUBJECTS rows at most
    rows = blocks.select(F.col(subject).cast("string").alias("subject"), F.col(block).cast("string").alias("block"), F.col(embedding).cast("array<double>").alias("x"))
    return held(rows.join(F.broadcast(known), "subject").select("block", "pos", "x").repartition("block").sortWithinPartitions("block"))


def _whole_blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[str, np.ndarray]]:
    """(block, subjects x features) from rows sorted by block; every subject must be there once."""
    parts: list[pa.RecordBatch] = []
    current = None

    def ready() -> tuple[str, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        pos = table["pos"].to_numpy()
        if len(pos) != n or (np.bincount(pos, minlength=n) != 1).any():
            raise ValueError(f"every subject needs every block once: block {current!r} has {len(pos)} rows of {len(np.unique(pos))} subjects, there are {n}")
        return current, matrix(table["x"].combine_chunks(), f"vectors of block {current}", True)[np.argsort(pos)]

    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.array(batch.column("block").to_pylist(), dtype=object)
        borders = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), batch.num_rows]
        for start, stop in zip(borders, borders[1:]):
            if parts and names[start] != current:
                yield ready()
                parts = []
            current = names[start]
            parts.append(batch.slice(start, stop - start))
    if parts:
        yield ready()


def _regression(c: np.ndarray, train: np.ndarray) -> np.ndarray:
    """H with H x = coefficients of x on the covariates over the training rows."""
    own = c[train]
    return np.linalg.pinv(own.T @ own) @ own.T


def _scales(x: np.ndarray, near: np.ndarray, c: np.ndarray, train: np.ndarray, standardize: bool) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of `near` (residuals on all rows) over the training rows, and 1 / sd of what is left; 0 for constant features."""
    own, coef = near[train], _regression(c, train) @ near[train]
    left = own - c[train] @ coef
    var = np.einsum("ij,ij->j", left, left) / len(train)
    constant = var <= 1e-12 * np.maximum(np.einsum("ij,ij->j", x[train], x[train]) / len(train), 1e-300)
    inverse = np.where(constant, 0.0, 1 / np.sqrt(np.where(constant, 1.0, var))) if standardize else np.where(constant, 0.0, 1.0)
    return coef, inverse


def _residuals(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Off the covariates over all rows: no later projection sees the difference, but rounding does."""
    return x - c @ np.linalg.lstsq(c, x, rcond=None)[0]


def _tiles(gram: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for i in range(0, len(gram), TILE):
        for j in range(i, len(gram), TILE):
            yield i, j, gram[i : i + TILE, j : j + TILE]


_TILES = "gram int, part int, i int, j int, cells array<double>"


def _summed(tiles: DataFrame, tasks: int) -> DataFrame:
    """Tiles of all tasks added up, in two levels, so that no group holds more than the root of their number."""
    schema = pa.schema([("gram", pa.int32()), ("part", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("cells", pa.list_(pa.float64()))])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for batch in table.to_batches():
            cells = matrix(batch.column("cells"))
            total = cells.sum(axis=0) if total is None else total + cells.sum(axis=0)
        head = {k: table[k][0].as_py() for k in ("gram", "part", "i", "j")}
        return pa.Table.from_pylist([{**head, "cells": total}], schema=schema)

    fan = int(np.ceil(np.sqrt(tasks)))
    for level in ([fan, 1] if fan > 8 else [1]):
        tiles = tiles.withColumn("part", F.pmod("part", F.lit(level)).cast("int")).groupBy("gram", "i", "j", "part").applyInArrow(add, _TILES)
    return tiles


def gram_tiles(layout: DataFrame, subjects: Subjects, subsets: Sequence[Subset], standardize: bool = True) -> DataFrame:
    """Upper tiles of every subset's weighted Gram matrix of its rows (training rows first), features scaled by its training rows.

    One job: a task adds up its blocks for as many subsets as `TASK_CELLS` allows; further lots read the held blocks again.
    """
    lots: list[list[Subset]] = [[]]
    room = TASK_CELLS
    for s in subsets:
        cells = len(s.rows) ** 2
        if lots[-1] and cells > room:
            lots.append([])
            room = TASK_CELLS
        lots[-1].append(s)
        room -= cells
    n, c = subjects.n, subjects.c

    def job(lot: list[Subset]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            sums = None
            for _, x in _whole_blocks(batches, n):
                near = _residuals(x, c)
                sums = sums or [np.zeros((len(s.rows), len(s.rows))) for s in lot]
                for s, total in zip(lot, sums):
                    scaled = near[s.rows] * _scales(x, near, c, s.train, standardize)[1]
                    total += scaled @ scaled.T
            part = TaskContext.get().partitionId()
            for s, total in zip(lot, sums or []):
                for i, j, tile in _tiles(total):
                    yield pa.RecordBatch.from_pylist([{"gram": s.key, "part": part, "i": i, "j": j, "cells": tile.ravel()}], schema=pa.schema([("gram", pa.int32()), ("part", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("cells", pa.list_(pa.float64()))]))

        return run

    parts = [layout.mapInArrow(job(lot), _TILES) for lot in lots if lot]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return _summed(out, layout.rdd.getNumPartitions() * len(parts))


def _assembled(table: pa.Table, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for i, j, cells in zip(table["i"].to_pylist(), table["j"].to_pylist(), table["cells"]):
        tile = cells.values.to_numpy().reshape(min(TILE, n - i), min(TILE, n - j))
        out[i : i + tile.shape[0], j : j + tile.shape[1]] = tile
        out[j : j + tile.shape[1], i : i + tile.shape[0]] = tile.T
    return out


@dataclass
class DualPCA:
    """Components of one training set in the dual: scores = K[:, train] @ dual."""

    scores: np.ndarray  # subset rows x k, training rows first
    dual: np.ndarray  # training rows x k: unit eigenvectors over the root of their eigenvalue; Z_train' @ dual = components
    eigenvalues: np.ndarray
    total_variance: float


def dual_pca(gram: np.ndarray, c: np.ndarray, n_train: int, k: int) -> DualPCA:
    """PCA of the first `n_train` rows behind a weighted Gram matrix, covariates `c` (with intercept) taken off by those rows; scores of all rows."""
    train = slice(0, n_train)
    hat = c @ _regression(c, np.arange(n_train))  # rows x training rows
    gram = gram - hat @ gram[train]
    gram = gram - gram[:, train] @ hat.T
    own = (gram[train, train] + gram[train, train].T) / 2
    values, vectors = np.linalg.eigh(own)
    order = np.argsort(values)[::-1][:k]
    top = np.maximum(values[order], 0.0)
    some = top > RANK * max(top.max(initial=0.0), 1e-300)
    dual = np.where(some, vectors[:, order] / np.sqrt(np.where(some, top, 1.0)), 0.0)
    # Largest training score of each component positive.
    scores = gram[:, train] @ dual
    sign = np.sign(scores[np.abs(scores[train]).argmax(axis=0), np.arange(len(order))]) if len(order) else np.zeros(0)
    sign = np.where(sign == 0, 1.0, sign)
    return DualPCA(scores * sign, dual * sign, top / n_train, float(np.trace(own)) / n_train)


def solve_subsets(
    layout: DataFrame,
    subjects: Subjects,
    subsets: Sequence[Subset],
    use: Callable[[Subset, DualPCA], pa.Table],
    schema: str,
    k: int,
    scales: str = "train",
    standardize: bool = True,
    lots: int | None = None,
) -> DataFrame:
    """`use` of every subset's PCA, one task per lot of subsets.

    scales: "train" takes a feature's scale from each subset's training rows, which needs a weighted sum per subset; "all" takes it from all subjects once, and
    then every subset is a selection of rows and columns of one matrix.
    """
    if scales == "train":
        tiles = gram_tiles(layout, subjects, subsets, standardize)
        jobs = [(s.key, [s]) for s in subsets]
    elif scales == "all":
        everyone = Subset(0, np.arange(subjects.n), np.zeros(0, np.int64))
        tiles = gram_tiles(layout, subjects, [everyone], standardize)
        count = min(len(subsets), lots or max(4 * layout.sparkSession.sparkContext.defaultParallelism, 1))
        jobs = [(0, list(subsets[i::count])) for i in range(count)]
    else:
        raise ValueError(f"unknown scales: {scales}")
    rows = layout.sparkSession.createDataFrame([(i, gram) for i, (gram, _) in enumerate(jobs)], "lot int, gram int")
    dealt = tiles.join(F.broadcast(rows), "gram")  # a row per lot
    c = subjects.c

    def run(table: pa.Table) -> pa.Table:
        out = []
        for s in jobs[table["lot"][0].as_py()][1]:
            if scales == "train":
                gram = _assembled(table, len(s.rows))
            else:
                whole = _assembled(table, len(c)) if not out else whole
                gram = whole[np.ix_(s.rows, s.rows)]
            out.append(use(s, dual_pca(gram, c[s.rows], len(s.train), k)))
        return pa.concat_tables(out)

    return dealt.groupBy("lot").applyInArrow(run, schema)


def block_maps(layout: DataFrame, subjects: Subjects, train: np.ndarray, weights: np.ndarray, variate: np.ndarray | None = None, standardize: bool = True) -> DataFrame:
    """(block, dim, component, weight, loading) of every feature: a second pass that maps dual weights back, block by block.

    `weights` (training rows x components): Z_train' @ weights are the feature weights. `variate` (training rows x components): its correlation with the
    prepared feature is the loading.
    """
    n, c = subjects.n, subjects.c
    unit = None
    if variate is not None:
        centred = variate - variate.mean(axis=0)
        length = np.sqrt((centred**2).sum(axis=0))
        unit = np.where(length > 0, centred / np.where(length > 0, length, 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, x in _whole_blocks(batches, n):
            near = _residuals(x, c)
            coef, inverse = _scales(x, near, c, train, standardize)
            z = (near[train] - c[train] @ coef) * inverse
            w = z.T @ weights
            length = np.sqrt((z**2).sum(axis=0))
            load = (z.T @ unit) / np.where(length > 0, length, 1.0)[:, None] if unit is not None else np.full(w.shape, np.nan)
            d, m = w.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (d * m)), pa.array(np.repeat(np.arange(d, dtype=np.int32), m)), pa.array(np.tile(np.arange(m, dtype=np.int32), d)), pa.array(w.ravel()), pa.array(load.ravel())],
                names=["block", "dim", "component", "weight", "loading"],
            )

    return layout.mapInArrow(run, "block string, dim int, component int, weight double, loading double")


def md5_order(ids: Sequence[str], seed: int, salt: int | str = "") -> np.ndarray:
    """Positions of the ids in the order of md5(id|seed|salt): a shuffle that any engine can repeat."""
    return np.array(sorted(range(len(ids)), key=lambda k: (hashlib.md5(f"{ids[k]}|{seed}|{salt}".encode()).hexdigest(), ids[k])), dtype=np.int64)
