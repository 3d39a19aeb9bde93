"""Wide views of more subjects than the dual takes: the features x features side of the same fits.

`operators.dual` sums subjects x subjects matrices, which many subjects outgrow. Where features are the fewer, a subject's blocks are put together to one row
z = [1, covariates, features, second view], and all that a training set needs are sums of z z' (`moments`): their size depends on the features alone. A
matrix is solved in the task of its key; what leaves it are maps and scores of components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators import solve
from pairlens.operators.decode import matrix
from pairlens.operators.dual import RANK
from pairlens.operators.moments import MAX_DIM, Layout, collect_moments, matrix_from_cells, moments, sum_rows
from pairlens.operators.ranking import hash_order
from pairlens.session import held

DUAL_SUBJECTS = 2048  # up to so many subjects the dual is taken whatever the features are
LOT_CELLS = 16_000_000  # doubles of sums that a task of `permuted_moments` holds; further permutations take another pass over the held rows


@dataclass
class Primal:
    """Held rows (subject_id, columns..., z) with z = [1, covariates, features, second view]."""

    rows: DataFrame
    layout: Layout
    features: list[tuple[str, int]]  # (block, dim) in the order of the features
    n: int


def primal(blocks: DataFrame, rows: DataFrame, columns: Sequence[str] = (), subject: str = "subject_id", block: str = "gene", embedding: str = "embedding") -> Primal | None:
    """The rows of both views by subject, or None where the dual is to be taken: few subjects, or no fewer features than subjects.

    rows: (subject, c, b, columns...), one per subject. Subjects without a row are left out; every other one must have every block once.
    """
    if rows.select(subject).limit(DUAL_SUBJECTS + 1).count() <= DUAL_SUBJECTS:
        return None
    sides = held(rows.select(F.col(subject).cast("string").alias("subject_id"), F.col("c").cast("array<double>").alias("_c"), F.col("b").cast("array<double>").alias("_y"), *columns))
    n, ids, n_cov, q = sides.agg(F.count(F.lit(1)), F.count_distinct("subject_id"), F.max(F.size("_c")), F.max(F.size("_y"))).first()
    if ids < n:
        raise ValueError("subjects must be there once, with an id")
    own = blocks.select(F.col(subject).cast("string").alias("subject_id"), F.col(block).cast("string").alias("block"), F.col(embedding).cast("array<double>").alias("x"))
    own = own.join(sides.select("subject_id"), "subject_id", "left_semi")
    widths = sorted(own.groupBy("block").agg(F.min(F.size("x")), F.max(F.size("x"))).limit(MAX_DIM + 1).collect())
    p = sum(w[2] or 0 for w in widths)
    layout = Layout(n_cov, p, q)
    if layout.dim > MAX_DIM or p >= n:
        return None
    if odd := [w[0] for w in widths if w[1] != w[2]]:
        raise ValueError(f"vectors of block {odd[0]} have different lengths")
    gathered = own.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("block", "x"))).alias("_b"))
    whole = (F.size("_b") == len(widths)) & (F.size(F.array_distinct(F.transform("_b", lambda s: s["block"]))) == len(widths))
    fault = F.concat(F.lit("every subject needs every block once: subject "), "subject_id", F.lit(f" has not; there are {len(widths)} blocks"))
    x = F.when(whole, F.flatten(F.transform("_b", lambda s: s["x"]))).otherwise(F.raise_error(fault).cast("array<double>"))
    z = F.concat(F.array(F.lit(1.0)), "_c", x, "_y")
    out = held(sides.join(gathered, "subject_id", "left").select("subject_id", *columns, z.alias("z")))
    sides.unpersist()
    return Primal(out, layout, [(w[0], d) for w in widths for d in range(w[2])], n)


def solved(cells: DataFrame, keys: Sequence[str], dim: int, use: Callable[[tuple, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """`use` of the key and the training and scored moments behind (keys..., i, j, s_train, s_eval): a task per key."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        return use(tuple(k.as_py() for k in key), *(matrix_from_cells(i, j, table[s].to_numpy(), dim) for s in ("s_train", "s_eval")))

    return cells.groupBy(*keys).applyInArrow(run, schema)


def prepared(m: np.ndarray, layout: Layout, standardize: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """`solve.linear_prep` with constant features at 0 as in the dual, and the factors 1 / sd (or 1) and 0 that make it so."""
    w = solve.linear_prep(m, layout, standardize=False)
    var = np.einsum("ij,ij->j", w, m @ w) / m[0, 0]
    constant = var <= solve.ZERO_VARIANCE * np.maximum(np.diag(m)[layout.x.start :] / m[0, 0], 1e-300)
    inverse = np.where(constant, 0.0, 1 / np.sqrt(np.where(constant, 1.0, var)) if standardize else 1.0)
    return w * inverse, inverse


def inverse_scales(own: Primal) -> np.ndarray:
    """1 / sd of every feature off the covariates over all subjects; 0 for constant ones."""
    return prepared(collect_moments(moments(own.rows, [], "z"))[()], own.layout)[1][: own.layout.p]


def component_map(m: np.ndarray, layout: Layout, k: int, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Map from z to [1, covariates, scores, second view], by `k` components of the features prepared by the training rows behind `m`; components; features' covariance.

    `scale` fixes the inverse scales of the features. Components without variance have scores 0, as in `dual.dual_pca`.
    """
    if scale is None:
        w = prepared(m, layout)[0][:, : layout.p]
    else:
        w = solve.linear_prep(m, layout, standardize=False)[:, : layout.p] * scale
    cov = solve.covariance(m, w)[2]
    values, components = solve.pca(cov, k)
    components = np.where(values > RANK * max(values.max(initial=0.0), 1e-300), components, 0.0)
    eye = np.eye(layout.dim)
    return np.hstack([eye[:, layout.cov], w @ components, eye[:, layout.y]]), components, cov


def hash_cuts(rows: DataFrame, n: int, perms: Sequence[int], places: Sequence[int], seed: int) -> dict[tuple[int, int], tuple[str, str]]:
    """(md5, subject) at the given places (from 1) of every permutation's md5 order, see `dual.md5_order`; no rows are sorted but those that share a hash prefix with them."""
    spark = rows.sparkSession
    digits = max(1, int(np.ceil(np.log2(max(n, 2) / 256) / 4)))
    numbers = F.broadcast(spark.createDataFrame([(int(b),) for b in perms], "perm_id int"))
    key = hash_order("subject_id", F.concat(F.lit(f"{seed}|"), F.col("perm_id").cast("string")))
    hashed = rows.select("subject_id").crossJoin(numbers).withColumn("_h", key).withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy("perm_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("perm_id").orderBy("_b"))  # about n / 256 rows
    borders = sizes.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))
    wanted = F.broadcast(spark.createDataFrame([(int(p),) for p in sorted(set(places))], "place long"))
    borders = borders.join(wanted, (F.col("_from") < F.col("place")) & (F.col("place") <= F.col("_upto"))).select("perm_id", "_b", "place", "_from")
    inner = Window.partitionBy("perm_id", "place").orderBy("_h", "subject_id")  # the rows of one prefix
    ranked = hashed.join(F.broadcast(borders), ["perm_id", "_b"]).withColumn("_rank", F.row_number().over(inner) + F.col("_from"))
    return {(r["perm_id"], r["place"]): (r["_h"], r["subject_id"]) for r in ranked.where("_rank = place").collect()}  # a row per permutation and place


def permuted_moments(own: Primal, perms: Sequence[int], n_case: int, fraction: float, seed: int) -> DataFrame:
    """(perm_id, g, i, j, s_train, s_eval) of case (1) and control (0) groups as `plans.wide.permuted_groups` deals them, without a copy of the rows per permutation."""
    hold1, hold0 = int(np.ceil(fraction * n_case)), n_case + int(np.ceil(fraction * (own.n - n_case)))
    places = [hold1, n_case, hold0]
    found = hash_cuts(own.rows, own.n, perms, [p for p in places if p], seed)
    cuts = [[found.get((b, p), ("", "")) for p in places] for b in perms]
    lot = max(1, LOT_CELLS // (4 * own.layout.dim**2))
    # Parts by place in the order: cases held out, cases trained on, controls held out, controls trained on.
    schema = "perm_id int, part int, i int, tail array<double>"

    def job(chosen: list[tuple[int, list]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                z, ids = matrix(batch.column("z"), finite=True), batch.column("subject_id").to_pylist()
                for b, (first, second, third) in chosen:
                    tail = f"|{seed}|{b}"
                    at = [(hashlib.md5((s + tail).encode()).hexdigest(), s) for s in ids]
                    part = np.array([(h > first) + (h > second) + (h > third) for h in at])
                    for code in np.unique(part).tolist():
                        rows = z[part == code]
                        gram = rows.T @ rows
                        sums[b, code] = sums[b, code] + gram if (b, code) in sums else gram
            for (b, code), gram in sums.items():
                d = len(gram)
                tails = [gram[i, i:] for i in range(d)]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in tails])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b] * d, pa.int32()), pa.array([code] * d, pa.int32()), pa.array(np.arange(d, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tails)))],
                    names=["perm_id", "part", "i", "tail"],
                )

        return run

    dealt = list(zip([int(b) for b in perms], cuts))
    jobs = [own.rows.select("subject_id", "z").mapInArrow(job(dealt[at : at + lot]), schema) for at in range(0, len(dealt), lot)]
    partial = jobs[0]
    for more in jobs[1:]:
        partial = partial.unionByName(more)
    g = F.when(F.col("part") < 2, 1).otherwise(0).alias("g")

    def of(parity: int):
        return F.sum(F.when(F.col("part") % 2 == parity, F.col("s")).otherwise(0.0))

    return sum_rows(partial, ["perm_id", "part"]).groupBy("perm_id", g, "i", "j").agg(of(1).alias("s_train"), of(0).alias("s_eval"))
