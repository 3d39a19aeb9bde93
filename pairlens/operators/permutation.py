"""Distributed permutation tests.

Rows are numbered once, in hash order, and a permutation is a keyed bijection of those numbers (a Feistel network, walked
until it falls inside the range), which every task computes on its own, in both directions. So all rows are permuted freely, at every
size and however the work is cut into blocks. A task holds a block of x rows, knows which y rows each of its permutations brings there, and
picks them up as y streams by in the order of the numbers: y travels once per wave, not once per permutation.
Tasks send cross-product matrices only; these are summed and solved one permutation per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators import solve
from pairlens.operators.decode import matrix
from pairlens.operators.linear import moment_matrix, project
from pairlens.operators.moments import FLUSH_CELLS, Layout, few_tasks, matrix_from_cells, sum_rows
from pairlens.operators.ranking import hash_rank
from pairlens.session import checkpointed

BLOCK_ROWS = 50_000
TASK_CELLS = 16_000_000  # doubles a task may hold as block rows, again as cross-products, and integers as places of y rows
_ROUNDS = 8


def _network(n: int, seed: int, perm: int) -> tuple[np.uint64, np.uint64, list]:
    """Half width, mask and round functions of a permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def mixing(key: np.uint64):
        def mix(right: np.ndarray) -> np.ndarray:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            return (mixed ^ (mixed >> np.uint64(32))) & mask

        return mix

    return np.uint64(half), mask, [mixing(key) for key in np.random.default_rng([seed, perm]).integers(0, 2**63, _ROUNDS, dtype=np.uint64)]


def _walked(once, position: np.ndarray, n: int) -> np.ndarray:
    out = once(position.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def permuted(position: np.ndarray, n: int, seed: int, perm: int) -> np.ndarray:
    """Where permutation `perm` of 0..n-1 sends each position."""
    half, mask, rounds = _network(n, seed, perm)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for mix in rounds:
            left, right = right, left ^ mix(right)
        return (left << half) | right

    return _walked(once, position, n)


def origin(position: np.ndarray, n: int, seed: int, perm: int) -> np.ndarray:
    """The position that permutation `perm` of 0..n-1 sends to each one: `permuted` backwards."""
    half, mask, rounds = _network(n, seed, perm)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for mix in reversed(rounds):
            left, right = right ^ mix(left), left
        return (left << half) | right

    return _walked(once, position, n)


def numbered(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """`df` with `_pos`: every row's number from 0, in the order of a hash of its id."""
    ranked = hash_rank(df, [], id_col, seed, "_pos")
    return checkpointed(ranked.withColumn("_pos", F.col("_pos").cast("long") - 1))


def _batch(keys: list[tuple[str, pa.DataType, list]], mats: list[np.ndarray]) -> pa.Table:
    i = np.concatenate([np.arange(m.shape[0], dtype=np.int32) for m in mats])
    lengths = np.concatenate([np.full(m.shape[0], m.shape[1]) for m in mats])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.concatenate([np.ascontiguousarray(m).ravel() for m in mats])
    repeat = [m.shape[0] for m in mats]
    cols = [pa.array(np.repeat(np.array(values), repeat), type=kind) for _, kind, values in keys]
    return pa.Table.from_arrays(
        [*cols, pa.array(i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[k for k, _, _ in keys] + ["i", "tail"]
    )


def waves(n: int, n_perm: int, p: int, q: int, parallelism: int, block_rows: int | None = None, perms_per_task: int | None = None) -> tuple[int, int]:
    """Rows and permutations of a wave: as few waves as memory allows, but enough to keep the cores busy."""
    block_rows = block_rows or max(1000, min(n, TASK_CELLS // max(p, 1)))
    blocks = max(1, -(-n // block_rows))
    room = max(1, min(TASK_CELLS // max(p * q, 1), TASK_CELLS // min(block_rows, max(n, 1))))
    share = -(-n_perm // max(1, -(-parallelism // blocks)))
    return block_rows, perms_per_task or max(1, min(room, share))


def permutation_null_rows(
    df: DataFrame,
    z: Column,
    layout: Layout,
    n_perm: int,
    k: int = 1,
    method: str = "cca",
    c1: float = 0.3,
    c2: float = 0.3,
    id_col: str = "subject_id",
    seed: int = 42,
    residualize: bool = True,
    block_rows: int | None = None,
    perms_per_task: int | None = None,
) -> tuple[np.ndarray, DataFrame]:
    """Observed correlations and the null (perm_id, component, r) from shuffling view y against view x.

    `block_rows` and `perms_per_task` bound a task's memory; the null does not depend on them. A wave is a block of x rows and a lot of permutations, and
    the y rows travel once per wave (`waves`).
    """
    p, q = layout.p, layout.q
    spark = df.sparkSession
    m = moment_matrix(df, z)
    model = solve.PairModel(m, layout, None, residualize)
    fit = model.fit(method, layout.p, k, c1, c2)
    n = int(round(m[0, 0]))
    block_rows, perms_per_task = waves(n, n_perm, p, q, spark.sparkContext.defaultParallelism, block_rows, perms_per_task)
    views = numbered(project(df, z, {"x": model.px, "y": model.py}, [id_col]), id_col, seed)
    blocks, lots = -(-n // block_rows), -(-n_perm // perms_per_task)
    tasks = blocks * lots
    block = F.floor(F.col("_pos") / block_rows).cast("int")
    stay = views.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(lots - 1)), lambda c: block * lots + c)).alias("task"), F.lit(0).alias("kind"), "_pos", F.col("x").alias("row"))
    passing = views.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(1).alias("kind"), "_pos", F.col("y").alias("row"))
    dealt = stay.unionByName(passing).repartitionById(tasks, "task").sortWithinPartitions("task", "kind", "_pos")

    def crossed(batches):
        current, x, place, wanted, sums = None, [], [], {}, {}

        def finished():
            if sums:
                ids = sorted(sums)
                yield from _batch([("perm_id", pa.int32(), ids)], [sums[b] for b in ids]).to_batches()

        for batch in batches:
            task, kind = (batch.column(c).to_numpy() for c in ("task", "kind"))
            borders = [0, *(np.flatnonzero(np.diff(2 * task + kind)) + 1), batch.num_rows]
            for start, stop in zip(borders, borders[1:]):
                if start == stop:
                    continue
                if task[start] != current:
                    yield from finished()
                    current, x, place, wanted, sums = int(task[start]), [], [], {}, {}
                rows, position = matrix(batch.column("row").slice(start, stop - start)), batch.column("_pos").to_numpy()[start:stop]
                if kind[start] == 0:
                    x.append(rows)
                    place.append(position)
                    continue
                if not wanted:
                    x, place = np.vstack(x), np.concatenate(place)
                    for b in range(current % lots * perms_per_task, min((current % lots + 1) * perms_per_task, n_perm)):
                        source = origin(place, n, seed, b)
                        order = np.argsort(source, kind="stable")
                        wanted[b] = (order, source[order])
                        sums[b] = np.zeros((p, q))
                for b, (order, source) in wanted.items():
                    # y comes in the order of its numbers, without gaps.
                    lo, hi = np.searchsorted(source, [position[0], position[-1] + 1])
                    if lo < hi:
                        sums[b] += x[order[lo:hi]].T @ rows[source[lo:hi] - position[0]]
        yield from finished()

    partial = dealt.mapInArrow(crossed, "perm_id int, i int, tail array<double>")
    sums = sum_rows(partial, ["perm_id"])
    sxx, syy = model.cov[:p, :p], model.cov[p:, p:]
    whiten = (solve._inverse_root(sxx), solve._inverse_root(syy)) if method == "cca" else None

    def solve_one(pdf):
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy() - pdf["i"].to_numpy()
        sxy = np.zeros((i.max() + 1, j.max() + 1))
        sxy[i, j] = pdf["s"].to_numpy() / n  # both views are centred, whole-table sums stay zero under shuffling
        if whiten is not None:
            r = np.linalg.svd(whiten[0].T @ sxy @ whiten[1], compute_uv=False)[:k]
        else:
            a, b = solve.scca(sxy, min(k, *sxy.shape), c1, c2)
            r = solve.pair_correlations(sxx, sxy, syy, a, b)
        return pd.DataFrame({"perm_id": pdf["perm_id"].iloc[0], "component": np.arange(len(r)), "r": np.nan_to_num(r)})

    null = sums.groupBy("perm_id").applyInPandas(solve_one, "perm_id int, component int, r double")
    return fit.r_train, null


def permutation_null_groups(
    df: DataFrame,
    z: Column,
    layout: Layout,
    n_perm: int,
    method: str,
    pca_dim: int,
    k: int = 1,
    c1: float = 0.3,
    c2: float = 0.3,
    label: str = "y",
    id_col: str = "subject_id",
    fraction: float = 0.2,
    seed: int = 42,
    completed: DataFrame | None = None,
) -> DataFrame:
    """Null of the difference of holdout correlations between two label groups under shuffled labels.

    Every permutation refits preparation, PCA and the canonical model of both groups on their training rows. The groups keep their
    sizes: the rows that a permutation sends to the first places are the cases, the others the controls, and the
    first ceil(`fraction`) of each are held out. No row moves. `completed` (perm_id, ...) rows are kept and not computed again.
    """
    rows = df.where(F.col(label).isin(0, 1))
    counts = {int(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
    n_case, n = counts.get(1, 0), sum(counts.values())
    held = {1: int(np.ceil(fraction * n_case)), 0: int(np.ceil(fraction * (n - n_case)))}
    done = {r[0] for r in completed.select("perm_id").distinct().collect()} if completed is not None else set()
    todo = [b for b in range(n_perm) if b not in done]  # at most n_perm integers
    schema = "perm_id int, r_case double, r_control double, diff double"
    if not todo:
        return completed.select("perm_id", "r_case", "r_control", "diff")
    d = layout.dim
    upper = np.triu_indices(d)
    places = numbered(rows.select(F.col(id_col).cast("string").alias("_id"), z.cast("array<double>").alias("z")), "_id", seed)

    def summed(batches):
        sums: dict[tuple[int, int, int], np.ndarray] = {}

        def emitted():
            keys = list(sums)
            names = [("perm_id", pa.int32()), ("g", pa.int32()), ("hold", pa.int32())]
            table = _batch([(name, kind, [key[c] for key in keys]) for c, (name, kind) in enumerate(names)], [sums[key][None, :] for key in keys])
            sums.clear()
            return table.to_batches()

        for batch in batches:
            position, zs = batch.column(0).to_numpy(), matrix(batch.column(1), finite=True)
            for b in todo:
                target = permuted(position, n, seed, b)
                case = target < n_case
                hold = np.where(case, target < held[1], target - n_case < held[0])
                for g in (0, 1):
                    for s in (0, 1):
                        part = zs[(case == g) & (hold == s)]
                        if len(part):
                            gram = (part.T @ part)[upper]
                            sums[b, g, s] = sums[b, g, s] + gram if (b, g, s) in sums else gram
                if len(sums) * len(upper[0]) > FLUSH_CELLS:
                    yield from emitted()
        if sums:
            yield from emitted()

    partial = few_tasks(places.select("_pos", "z")).mapInArrow(summed, "perm_id int, g int, hold int, i int, tail array<double>")
    sums = sum_rows(partial, ["perm_id", "g", "hold"])

    def solve_one(pdf):
        r = {}
        for g in (0, 1):
            mats = []
            for hold in (0, 1):
                part = pdf[(pdf["g"] == g) & (pdf["hold"] == hold)]
                flat = np.zeros(len(upper[0]))
                flat[part["j"].to_numpy()] = part["s"].to_numpy()
                mats.append(matrix_from_cells(upper[0], upper[1], flat, d))
            train, held_out = mats
            if train[0, 0] + held_out[0, 0] < 10:
                r[g] = 0.0
                continue
            model = solve.PairModel(train, layout, pca_dim)
            fit = model.fit(method, pca_dim, k, c1, c2)
            r[g] = float(np.nan_to_num(model.score(fit, held_out)[0]))
        b = int(pdf["perm_id"].iloc[0])
        return pd.DataFrame({"perm_id": [b], "r_case": [r[1]], "r_control": [r[0]], "diff": [r[1] - r[0]]})

    fresh = sums.groupBy("perm_id").applyInPandas(solve_one, schema)
    return fresh if completed is None else completed.select("perm_id", "r_case", "r_control", "diff").unionByName(fresh)
