"""Randomized PCA of very wide views kept long by feature block.

The wide row never exists: a subject's blocks share a partition, and each pass adds
up A'(A M) block by block, where M is a thin matrix of candidate directions. A pass
is one map over the data and one sum of (features x directions) partial matrices.
Covariates and scaling enter as per-block linear terms fitted on the training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.decode import key_groups, matrix
from pairlens.operators.moments import few_tasks, sum_rows
from pairlens.session import held

MAX_DIRECTION_CELLS = 128_000_000  # features x directions that may be shipped to every task (1 GB)


@dataclass
class BlockPCA:
    components: dict[str, np.ndarray]  # block name -> (block width x k)
    eigenvalues: np.ndarray
    total_variance: float
    prep: dict[str, tuple[np.ndarray, np.ndarray]]  # block name -> (coefficients on [1, cov], scale)
    n: int
    passes: int = 0  # data passes until the eigenvalues settled

    @property
    def explained_variance_ratio(self) -> float:
        return float(self.eigenvalues.sum() / self.total_variance) if self.total_variance > 0 else 0.0


def _rows_schema() -> T.StructType:
    return T.StructType(
        [T.StructField("block", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("tail", T.ArrayType(T.DoubleType()))]
    )


def _emit(block: str, mat: np.ndarray) -> pa.RecordBatch:
    """Matrix rows as tails; row i is padded to start at column i of the summed table."""
    d, width = mat.shape
    offsets = np.arange(d + 1, dtype=np.int32) * width
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * d),
            pa.array(np.arange(d, dtype=np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(mat).ravel())),
        ],
        names=["block", "i", "tail"],
    )


def _collect_blocks(partial: DataFrame) -> dict[str, np.ndarray]:
    table = sum_rows(partial, ["block"]).toPandas()
    out = {}
    for block, part in table.groupby("block"):
        i, j = part["i"].to_numpy(), part["j"].to_numpy()
        mat = np.zeros((i.max() + 1, (j - i).max() + 1))
        mat[i, j - i] = part["s"].to_numpy()
        out[block] = mat
    return out


def _block_groups(batch):
    for (name,), rows in key_groups([batch.column("block")], batch.num_rows):
        sub = batch.take(pa.array(rows))
        yield name, rows, matrix(sub.column("c"), f"covariates of block {name}", True), matrix(sub.column("x"), f"vectors of block {name}", True)


def _fit_prep(rows: DataFrame, residualize: bool, standardize: bool):
    def run(batches):
        sums: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for name, _, c, x in _block_groups(batch):
                top = c.T @ np.hstack([c, x])
                square = np.concatenate([np.zeros(c.shape[1]), np.einsum("ij,ij->j", x, x)])[None, :]
                part = np.vstack([top, square])
                sums[name] = sums[name] + part if name in sums else part
        for name, mat in sums.items():
            yield _emit(name, mat)

    stats = _collect_blocks(rows.mapInArrow(run, _rows_schema()))
    counts = {name: int(round(mat[0, 0])) for name, mat in stats.items()}
    if len(set(counts.values())) > 1:
        most = max(counts.values())
        short = sorted((c, name) for name, c in counts.items() if c < most)
        raise ValueError(f"every subject needs every block: {len(short)} blocks have fewer than {most} subjects, such as {short[:5]}")
    prep, total, n = {}, 0.0, 0
    for name, mat in stats.items():
        c = mat.shape[0] - 1
        ctc, ctx, sq = mat[:c, :c], mat[:c, c:], mat[c, c:]
        n = int(round(ctc[0, 0]))
        if residualize:
            coef = np.linalg.lstsq(ctc, ctx, rcond=None)[0]
        else:
            coef = np.zeros_like(ctx)
            coef[0] = ctx[0] / ctc[0, 0]
        # The intercept is among the covariates, so residuals have mean zero.
        var = np.maximum((sq - 2 * np.einsum("ij,ij->j", coef, ctx) + np.einsum("ij,ij->j", coef, ctc @ coef)) / n, 0)
        constant = var <= 1e-12 * np.maximum(sq / n, 1e-300)
        scale = np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, var))) if standardize else np.ones_like(var)
        prep[name] = (coef, scale)
        total += float((np.where(constant, 0.0, var) / scale**2).sum())
    return prep, total, n


def _whole_subjects(batches):
    """Re-cut batches so that the rows of a subject stay together (input is sorted by subject)."""
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        ids = batch.column("subject")
        last = ids[batch.num_rows - 1].as_py()
        cut = batch.num_rows
        while cut > 0 and ids[cut - 1].as_py() == last:
            cut -= 1
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _apply(batch, prep, directions):
    """Per-subject scores of a batch and the prepared blocks they came from."""
    ids = np.array(batch.column("subject").to_pylist(), dtype=object)
    uniq, code = np.unique(ids.astype(str), return_inverse=True)
    width = next(iter(directions.values())).shape[1]
    scores, kept = np.zeros((len(uniq), width)), []
    met = np.zeros(len(uniq), np.int64)
    for name, rows, c, x in _block_groups(batch):
        if name not in prep:
            raise ValueError(f"block {name!r} was not there in training")
        np.add.at(met, code[rows], 1)
        coef, scale = prep[name]
        z = (x - c @ coef) / scale
        np.add.at(scores, code[rows], z @ directions[name])
        kept.append((name, code[rows], z))
    if (met != len(prep)).any():
        odd = np.flatnonzero(met != len(prep))
        raise ValueError(f"every subject needs every block once: {len(odd)} subjects have not, such as {uniq[odd[0]]!r} with {met[odd[0]]} of {len(prep)}")
    return uniq, scores, kept


def block_layout(
    blocks: DataFrame,
    covariates: DataFrame | None = None,
    subject: str = "subject_id",
    block: str = "gene",
    embedding: str = "embedding",
    tag: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Blocks placed by subject: (subject, block, c, x, tag). The one shuffle of the data.

    `covariates` has (subject, covariates array); `tag` is any column to select rows by later.
    The number of partitions is Spark's choice unless given.
    """
    parts = [partitions] if partitions else []
    c = F.array(F.lit(1.0))
    rows = blocks
    if covariates is not None:
        rows = rows.join(covariates, subject)
        c = F.concat(c, F.col("covariates").cast("array<double>"))
    return (
        rows.select(
            F.col(subject).cast("string").alias("subject"), F.col(block).cast("string").alias("block"), c.alias("c"),
            F.col(embedding).cast("array<double>").alias("x"), (F.lit(True) if tag is None else tag).alias("tag"),
        )
        .repartition(*parts, "subject")
        .sortWithinPartitions("subject")
    )


def fit_blocks(
    layout: DataFrame,
    k: int,
    where: Column | None = None,
    oversample: int = 10,
    passes: int = 60,
    tol: float = 1e-6,
    seed: int = 42,
    residualize: bool = True,
    standardize: bool = True,
) -> BlockPCA:
    """Leading components of the prepared blocks, from the layout rows where `where` holds.

    Each pass moves features x directions sums only. Passes stop once the leading eigenvalues
    have settled to `tol`; if `passes` do not suffice, that is an error. Absent blocks are errors too.
    """
    spark = layout.sparkSession
    # Coalescing appends whole partitions, so the rows of a subject stay together.
    rows = few_tasks(layout if where is None else layout.filter(where))
    prep, total, n = _fit_prep(rows, residualize, standardize)
    if not prep:
        raise ValueError("no training rows")
    names = sorted(prep)
    widths = {g: prep[g][1].shape[0] for g in names}
    dims = sum(widths.values())
    width = min(k + oversample, dims, max(n - 1, 1))
    if dims * width > MAX_DIRECTION_CELLS:
        raise ValueError(f"{dims} features x {width} directions is too large to ship; pool the blocks or lower k")

    def split(mat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for g in names:
            out[g] = mat[at : at + widths[g]]
            at += widths[g]
        return out

    start = np.random.default_rng(seed).standard_normal((dims, width))
    m = np.linalg.qr(start)[0]
    last = np.zeros(k)
    for done in range(1, passes + 1):
        shared = spark.sparkContext.broadcast((prep, split(m)))

        def run(batches):
            local_prep, directions = shared.value
            sums: dict = {}
            for batch in _whole_subjects(batches):
                _, scores, kept = _apply(batch, local_prep, directions)
                gram = scores.T @ scores
                sums[""] = sums[""] + gram if "" in sums else gram
                for name, code, z in kept:
                    part = z.T @ scores[code]
                    sums[name] = sums[name] + part if name in sums else part
            for name, mat in sums.items():
                yield _emit(name, mat)

        got = _collect_blocks(rows.mapInArrow(run, _rows_schema()))
        gram = got.pop("") / n
        basis = m
        m = np.linalg.qr(np.vstack([got[g] for g in names]))[0]
        shared.unpersist()
        values, vectors = np.linalg.eigh(gram)
        order = np.argsort(values)[::-1][:k]
        top, last = last, values[order]
        if width == dims:
            break  # the directions span the whole space, so the first pass is exact
        if len(top) == len(last) and np.abs(top - last).max() <= tol * last.max():
            break
    else:
        raise RuntimeError(f"the eigenvalues have not settled to {tol} in {passes} passes; allow more, or a larger tol")
    comps = basis @ vectors[:, order]
    sign = np.sign(comps[np.abs(comps).argmax(axis=0), np.arange(comps.shape[1])])
    comps = comps * np.where(sign == 0, 1.0, sign)
    return BlockPCA(split(comps), np.maximum(values[order], 0), total, prep, n, done)


def score_blocks(layout: DataFrame, model: BlockPCA, subject: str = "subject_id") -> DataFrame:
    """(subject, pcs) of every subject in the layout under a fitted model."""
    final = layout.sparkSession.sparkContext.broadcast((model.prep, model.components))

    def score(batches):
        local_prep, directions = final.value
        for batch in _whole_subjects(batches):
            ids, scores, _ = _apply(batch, local_prep, directions)
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * scores.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(ids), type=pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel()))],
                names=[subject, "pcs"],
            )

    return layout.mapInArrow(score, f"`{subject}` string, pcs array<double>")


def block_pca(
    blocks: DataFrame,
    k: int,
    covariates: DataFrame | None = None,
    train: Column | None = None,
    subject: str = "subject_id",
    block: str = "gene",
    embedding: str = "embedding",
    partitions: int | None = None,
    **options,
) -> tuple[BlockPCA, DataFrame]:
    """Fit on the rows where `train` holds, score all: layout, fit and scores in one call."""
    layout = held(block_layout(blocks, covariates, subject, block, embedding, train, partitions))
    model = fit_blocks(layout, k, F.col("tag"), **options)
    return model, score_blocks(layout, model, subject)


def components_table(spark, model: BlockPCA) -> DataFrame:
    """(feature, gene, dim, pc, loading) rows; features x k, the size of the metadata."""
    rows = [
        (f"{g}_{d}", g, d, pc, float(v)) for g, mat in model.components.items() for d, row in enumerate(mat) for pc, v in enumerate(row)
    ]
    return spark.createDataFrame(rows, "feature string, gene string, dim int, pc int, loading double")
