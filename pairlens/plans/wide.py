"""Coupling of a very wide view (feature blocks) with a second view, by the dual of `operators.dual`.

Every fold, group and permutation gets preparation and PCA of its own training rows, and all of them come from one pass over the
blocks. The second view and the covariates of the subjects travel with the tasks. With more than `primal.DUAL_SUBJECTS` subjects and fewer features than
subjects, the same fits come from the features' side (`operators.primal`), which takes any number of subjects.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import reports, solve
from pairlens.operators.classify import FoldModel, balanced_weights, scaled_map
from pairlens.operators.block_scca import block_scca
from pairlens.operators.dual import DualPCA, Subjects, Subset, block_maps, dual_layout, md5_order, read_subjects, solve_subsets
from pairlens.operators.interpret import cosine_similarity, gene_weight_rollup, topk_features
from pairlens.operators.decode import matrix
from pairlens.operators.moments import MAX_DIM, Layout, collect_moments, moments
from pairlens.operators.primal import Primal, component_map, inverse_scales, permuted_moments, prepared, primal, solved
from pairlens.plans import suite
from pairlens.plans.coupling import HOLDOUT, grid_on_cells, grid_results, total_minus_fold
from pairlens.session import held


def _moments(subjects: Subjects, subset: Subset, pca: DualPCA, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Moment matrices of z = [1, covariates, scores, second view] over the training and the scored rows."""
    scores = np.zeros((len(pca.scores), width))
    scores[:, : pca.scores.shape[1]] = pca.scores
    z = np.hstack([subjects.c[subset.rows], scores, subjects.y[subset.rows]])
    n = len(subset.train)
    return z[:n].T @ z[:n], z[n:].T @ z[n:]


def _width(subjects: Subjects, subsets: Sequence[Subset], top: int) -> int:
    """Components that every subset can have."""
    return max(1, min(top, *(len(s.train) - subjects.c.shape[1] for s in subsets)))


def fold_subsets(subjects: Subjects, keys: Sequence[str] = ()) -> tuple[list[Subset], list[tuple]]:
    """A subset per (keys..., fold): trained on the other folds of its key, the holdout (fold -1) on all of them. Also their (keys..., fold)."""
    fold = subjects.columns["fold"]
    groups = [np.asarray(subjects.columns[k]) for k in keys]
    names = sorted(set(zip(*(g.tolist() for g in groups)))) if keys else [()]
    subsets, labels = [], []
    for name in names:
        own = np.ones(subjects.n, bool)
        for g, value in zip(groups, name):
            own &= g == value
        for f in sorted(set(fold[own].tolist())):
            train = own & (fold != HOLDOUT) & (fold != f)
            subsets.append(Subset(len(subsets), np.flatnonzero(train), np.flatnonzero(own & (fold == f))))
            labels.append((*name, f))
    return subsets, labels


def fold_cells(layout: DataFrame, subjects: Subjects, top: int, keys: Sequence[str] = (), scales: str = "train") -> tuple[DataFrame, Layout]:
    """(keys..., fold, i, j, s_train, s_eval) of every fold's own components, covariates and second view, and their layout."""
    subsets, labels = fold_subsets(subjects, keys)
    width = _width(subjects, subsets, top)
    shape = Layout(subjects.c.shape[1] - 1, width, subjects.y.shape[1])
    if shape.dim > MAX_DIM:
        raise ValueError("too many components and features of the second view for a moment grid; lower the dimensions")
    upper = np.triu_indices(shape.dim)

    def cells(subset: Subset, pca: DualPCA) -> pa.Table:
        train, score = _moments(subjects, subset, pca, width)
        return pa.table({"subset": pa.array(np.full(len(upper[0]), subset.key), pa.int32()), "i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "s_train": train[upper], "s_eval": score[upper]})

    got = solve_subsets(layout, subjects, subsets, cells, "subset int, i int, j int, s_train double, s_eval double", width, scales)
    kinds = ", ".join(f"{k} string" for k in keys)
    names = layout.sparkSession.createDataFrame([(i, *map(str, label[:-1]), int(label[-1])) for i, label in enumerate(labels)], f"subset int, {kinds + ', ' if kinds else ''}fold int")
    return got.join(F.broadcast(names), "subset").drop("subset"), shape  # a row per fold and key


def fold_moments(own: Primal, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., fold, i, j, s_train, s_eval) of z, the subsets of `fold_subsets`."""
    named = own.rows.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("fold").cast("int").alias("fold"), "z")
    return held(total_minus_fold(moments(named, [*keys, "fold"], "z"), keys))


def _primal_width(cells: DataFrame, layout: Layout, top: int) -> int:
    least = cells.where("i = 0 and j = 0").agg(F.min("s_train")).first()[0]
    return max(1, min(top, layout.p, int(round(least)) - 1 - layout.n_cov))


def primal_cells(own: Primal, top: int, keys: Sequence[str] = (), scales: str = "train") -> tuple[DataFrame, Layout]:
    """`fold_cells` from the features' side."""
    if scales not in ("train", "all"):
        raise ValueError(f"unknown scales: {scales}")
    given = fold_moments(own, keys)
    layout, width = own.layout, _primal_width(given, own.layout, top)
    scale = inverse_scales(own) if scales == "all" else None
    shape = Layout(layout.n_cov, width, layout.q)
    upper = np.triu_indices(shape.dim)

    def cells(key: tuple, train: np.ndarray, score: np.ndarray) -> pa.Table:
        t = component_map(train, layout, width, scale)[0]
        size = len(upper[0])
        head = {k: pa.array([v] * size, pa.string()) for k, v in zip(keys, key)} | {"fold": pa.array([key[-1]] * size, pa.int32())}
        return pa.table({**head, "i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "s_train": (t.T @ train @ t)[upper], "s_eval": (t.T @ score @ t)[upper]})

    kinds = "".join(f"{k} string, " for k in keys)
    return solved(given, [*keys, "fold"], layout.dim, cells, f"{kinds}fold int, i int, j int, s_train double, s_eval double"), shape


def dual_grid(blocks: DataFrame, rows: DataFrame, grid: DataFrame, keys: Sequence[str] = (), n_components: int = 10, scales: str = "train", subject: str = "subject_id", **options) -> DataFrame:
    """Cross-validated grid with holdout whose first view is feature blocks: `coupling_grid` with a PCA per fold from one pass.

    blocks: (subject, gene, embedding); rows: (subject, fold, c, b, keys...), one per subject, with covariates and second view; more than
    `dual.MAX_SUBJECTS` need fewer features than subjects. Equal to `coupling.wide_coupling_grid`, which takes any number of both but repeats passes for every fold.
    """
    top = grid.agg(F.max("dim")).first()[0]
    if own := primal(blocks, rows, ["fold", *keys], subject):
        cells, shape = primal_cells(own, top, keys, scales)
    else:
        subjects = read_subjects(rows, columns=["fold", *keys], subject=subject)
        cells, shape = fold_cells(dual_layout(blocks, subjects, subject), subjects, top, keys, scales)
    return grid_results(grid_on_cells(cells, shape, grid, list(keys), n_components=n_components, reduced=True, **options), list(keys))


def _fitted(subjects: Subjects, subset: Subset, pca: DualPCA, config: dict, k: int) -> tuple[solve.PairModel, solve.Fit, np.ndarray]:
    """The configuration fitted on a subset's training rows, and its component correlations on the scored rows."""
    width = pca.scores.shape[1]
    return _fitted_moments(*_moments(subjects, subset, pca, width), Layout(subjects.c.shape[1] - 1, width, subjects.y.shape[1]), config, k)


def _fitted_moments(train: np.ndarray, score: np.ndarray, shape: Layout, config: dict, k: int) -> tuple[solve.PairModel, solve.Fit, np.ndarray]:
    """`_fitted` of the moments of [1, covariates, scores, second view] over training and scored rows."""
    model = solve.PairModel(train, shape, None, reduced=True)
    fit = model.fit(config["method"], config["dim"], k, 1.0 if config.get("c1") is None else config["c1"], 1.0 if config.get("c2") is None else config["c2"])
    return model, fit, model.score(fit, score) if score[0, 0] else np.full(fit.r_train.shape, np.nan)


def permuted_groups(subjects: Subjects, case: np.ndarray, perm: int | str, fraction: float, seed: int) -> dict[int, Subset]:
    """Case (1) and control (0) subsets when labels are dealt anew: the first places of the md5 order are the cases, the first `fraction` of each group is held out."""
    order = md5_order(subjects.ids, seed, perm)
    n_case = int(case.sum())
    out = {}
    for g, own in ((1, order[:n_case]), (0, order[n_case:])):
        hold = int(np.ceil(fraction * len(own)))
        out[g] = Subset(0, np.sort(own[hold:]), np.sort(own[:hold]))
    return out


def wide_label_null(
    blocks: DataFrame,
    rows: DataFrame,
    n_perm: int,
    method: str,
    dim: int,
    c1: float | None = None,
    c2: float | None = None,
    label: str = "y",
    fraction: float = 0.2,
    seed: int = 42,
    scales: str = "all",
    completed: DataFrame | None = None,
    subject: str = "subject_id",
) -> DataFrame:
    """(perm_id, r_case, r_control, diff): null of the difference of holdout correlations, preparation and PCA of the wide view refitted for both groups of each permutation.

    Groups keep their sizes. A group of fewer than 10 has correlation 0. `scales` as in `dual.solve_subsets`: "all" (the labels have no part in them) needs one pass over
    the blocks for all permutations; "train" refits them too, in lots of passes. Rows whose label is not 0 or 1 take no part. `completed` rows are kept and not computed again.
    """
    rows = rows.where(F.col(label).isin(0, 1))
    done = {r[0] for r in completed.select("perm_id").distinct().collect()} if completed is not None else set()
    todo = [b for b in range(n_perm) if b not in done]  # at most n_perm integers
    spark = rows.sparkSession
    if not todo:
        return completed.select("perm_id", "r_case", "r_control", "diff")
    config = {"method": method, "dim": dim, "c1": c1, "c2": c2}
    if own := primal(blocks, rows, [label], subject):
        return _null_table([_primal_null(own, todo, config, label, fraction, seed, scales)], completed)
    subjects = read_subjects(rows, columns=[label], subject=subject)
    case = subjects.columns[label] == 1
    subsets, zero = [], []
    for b in todo:
        for g, s in permuted_groups(subjects, case, b, fraction, seed).items():
            if len(s.rows) < 10:
                zero.append((b, g, 0.0))
            else:
                subsets.append(Subset(2 * b + g, s.train, s.score))

    def one(subset: Subset, pca: DualPCA) -> pa.Table:
        r = float(np.nan_to_num(_fitted(subjects, subset, pca, config, 1)[2][0]))
        return pa.table({"perm_id": pa.array([subset.key // 2], pa.int32()), "g": pa.array([subset.key % 2], pa.int32()), "r": pa.array([r], pa.float64())})

    parts = [spark.createDataFrame(zero, "perm_id int, g int, r double")] if zero else []
    if subsets:
        layout = dual_layout(blocks, subjects, subject)
        parts.append(solve_subsets(layout, subjects, subsets, one, "perm_id int, g int, r double", _width(subjects, subsets, dim), scales))
    return _null_table(parts, completed)


def _null_table(parts: list[DataFrame], completed: DataFrame | None) -> DataFrame:
    """Rows (perm_id, g, r) of both groups side by side, behind those that are there."""
    both = reports.union_results(*parts).groupBy("perm_id").agg(F.max(F.when(F.col("g") == 1, F.col("r"))).alias("r_case"), F.max(F.when(F.col("g") == 0, F.col("r"))).alias("r_control"))
    fresh = both.withColumn("diff", F.col("r_case") - F.col("r_control"))
    return fresh if completed is None else completed.select("perm_id", "r_case", "r_control", "diff").unionByName(fresh)


def _primal_null(own: Primal, perms: list[int], config: dict, label: str, fraction: float, seed: int, scales: str) -> DataFrame:
    """(perm_id, g, r) of `wide_label_null` from the features' side."""
    if scales not in ("train", "all"):
        raise ValueError(f"unknown scales: {scales}")
    n_case = own.rows.where(F.col(label) == 1).count()
    cells = permuted_moments(own, perms, n_case, fraction, seed)
    layout, scale = own.layout, inverse_scales(own) if scales == "all" else None
    sizes = {1: n_case, 0: own.n - n_case}
    least = min((n - int(np.ceil(fraction * n)) for n in sizes.values() if n >= 10), default=1)
    width = max(1, min(config["dim"], layout.p, least - 1 - layout.n_cov))
    shape = Layout(layout.n_cov, width, layout.q)

    def one(key: tuple, train: np.ndarray, score: np.ndarray) -> pa.Table:
        r = 0.0
        if sizes[key[1]] >= 10:
            t = component_map(train, layout, width, scale)[0]
            r = float(np.nan_to_num(_fitted_moments(t.T @ train @ t, t.T @ score @ t, shape, config, 1)[2][0]))
        return pa.table({"perm_id": pa.array([key[0]], pa.int32()), "g": pa.array([key[1]], pa.int32()), "r": pa.array([r], pa.float64())})

    got = solved(cells, ["perm_id", "g"], layout.dim, one, "perm_id int, g int, r double")
    absent = [(b, g, 0.0) for b in perms for g in (0, 1) if not sizes[g]]
    return got.unionByName(own.rows.sparkSession.createDataFrame(absent, "perm_id int, g int, r double")) if absent else got


def wide_export(
    blocks: DataFrame,
    rows: DataFrame,
    method: str,
    dim: int,
    c1: float | None = None,
    c2: float | None = None,
    k: int = 1,
    inflate: bool = False,
    subject: str = "subject_id",
) -> dict[str, DataFrame]:
    """The best configuration refitted on all training rows (fold >= 0), down to single features of the wide view.

    `variates` (subject_id, fold, u, v); `x_weights` (gene, dim, feature, component, weight, loading), distributed, from a second pass over the blocks; `y_weights`
    and `y_loadings` (position, component, weight); `genes` (component, gene, l2, mean_abs); `correlations` (component, r_train, r_holdout).
    """
    spark = rows.sparkSession
    config = {"method": method, "dim": dim, "c1": c1, "c2": c2}
    if own := primal(blocks, rows, ["fold"], subject):
        return _primal_export(own, config, k, inflate)
    subjects = read_subjects(rows, columns=["fold"], subject=subject)
    fold = subjects.columns["fold"]
    subset = Subset(0, np.flatnonzero(fold != HOLDOUT), np.flatnonzero(fold == HOLDOUT))
    layout = dual_layout(blocks, subjects, subject)
    n = len(subset.train)

    def fitted(s: Subset, pca: DualPCA) -> pa.Table:
        model, fit, r = _fitted(subjects, s, pca, config, k)
        kx = model.px.shape[1]
        load = solve.loadings(model.cov[kx:, kx:], fit.b, model.n, inflate)
        z = np.hstack([subjects.c[s.rows], pca.scores, subjects.y[s.rows]])
        named = {"u": z @ fit.wx, "v": z @ fit.wy, "dual": pca.dual[:, : len(fit.a)] @ fit.a, "b": fit.b, "load": load, "r": np.stack([fit.r_train, r])}
        return _named(named)

    parts = _matrices(solve_subsets(layout, subjects, [subset], fitted, _NAMED, _width(subjects, [subset], dim)))  # subjects x components at most
    u, v, r = parts["u"], parts["v"], parts["r"]
    x = block_maps(layout, subjects, subset.train, parts["dual"], u[:n])
    if inflate:
        x = x.withColumn("loading", F.col("loading") * (n / (n - 1)))
    x = x.select(F.col("block").alias("gene"), "dim", F.concat_ws("_", "block", "dim").alias("feature"), "component", "weight", "loading")
    side = [(str(subjects.ids[p]), int(fold[p]), u[i].tolist(), v[i].tolist()) for i, p in enumerate(subset.rows)]
    return _export_tables(spark.createDataFrame(side, "subject_id string, fold int, u array<double>, v array<double>"), x, parts["b"], parts["load"], r)


def _export_tables(variates: DataFrame, x: DataFrame, b: np.ndarray, load: np.ndarray, r: np.ndarray) -> dict[str, DataFrame]:
    spark = x.sparkSession
    long = lambda m: [(f, c, float(m[f, c])) for f in range(m.shape[0]) for c in range(m.shape[1])]
    kind = "position int, component int, weight double"
    return {
        "variates": variates,
        "x_weights": x,
        "y_weights": spark.createDataFrame(long(b), kind),
        "y_loadings": spark.createDataFrame(long(load), kind),
        "genes": gene_weight_rollup(x, keys=["component"]),
        "correlations": spark.createDataFrame([(i, float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(r[0], r[1]))], "component int, r_train double, r_holdout double"),
    }


_NAMED = "name string, width int, cells array<double>"


def _named(named: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({"name": list(named), "width": pa.array([m.shape[1] for m in named.values()], pa.int32()), "cells": pa.array([m.ravel().tolist() for m in named.values()], pa.list_(pa.float64()))})


def _matrices(got: DataFrame) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["cells"]).reshape(-1, r["width"]) for r in got.collect()}


def _train_and_holdout(own: Primal, fold: int = HOLDOUT) -> DataFrame:
    """(i, j, s_train, s_eval) of the training rows of one fold and its own; without a holdout nothing is scored by the final fit."""
    mom = moments(own.rows.select(F.col("fold").cast("int").alias("fold"), "z"), ["fold"], "z")

    def of(rows) -> F.Column:
        return F.sum(F.when(rows, F.col("s")).otherwise(0.0))

    own_fold = F.col("fold") == fold
    return mom.groupBy("i", "j").agg(of(~own_fold & (F.col("fold") != HOLDOUT)).alias("s_train"), of(own_fold).alias("s_eval")).withColumn("fold", F.lit(fold))


def _feature_table(own: Primal, weight: np.ndarray, loading: np.ndarray) -> DataFrame:
    """(gene, dim, feature, component, weight, loading); at most MAX_DIM features."""
    rows = [(g, d, f"{g}_{d}", c, float(weight[i, c]), float(loading[i, c])) for i, (g, d) in enumerate(own.features) for c in range(weight.shape[1])]
    return own.rows.sparkSession.createDataFrame(rows, "gene string, dim int, feature string, component int, weight double, loading double")


def _primal_export(own: Primal, config: dict, k: int, inflate: bool) -> dict[str, DataFrame]:
    """`wide_export` from the features' side."""
    layout, cells = own.layout, held(_train_and_holdout(own))
    width = _primal_width(cells, layout, config["dim"])
    shape = Layout(layout.n_cov, width, layout.q)

    def fitted(_: tuple, train: np.ndarray, score: np.ndarray) -> pa.Table:
        t, components, cov = component_map(train, layout, width)
        model, fit, r = _fitted_moments(t.T @ train @ t, t.T @ score @ t, shape, config, k)
        kx, weight = model.px.shape[1], components[:, : len(fit.a)] @ fit.a
        load = solve.loadings(model.cov[kx:, kx:], fit.b, model.n, inflate)
        return _named({"wx": t @ fit.wx, "wy": t @ fit.wy, "weight": weight, "x_load": solve.loadings(cov, weight, model.n, inflate), "b": fit.b, "load": load, "r": np.stack([fit.r_train, r])})

    parts = _matrices(solved(cells, ["fold"], layout.dim, fitted, _NAMED))  # features x components at most
    wx, wy = parts["wx"], parts["wy"]

    def run(batches):
        for batch in batches:
            z = matrix(batch.column("z"), finite=True)
            sides = []
            for m in (z @ wx, z @ wy):
                sides.append(pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("subject_id"), batch.column("fold"), *sides], names=["subject_id", "fold", "u", "v"])

    variates = own.rows.select("subject_id", F.col("fold").cast("int").alias("fold"), "z").mapInArrow(run, "subject_id string, fold int, u array<double>, v array<double>")
    return _export_tables(variates, _feature_table(own, parts["weight"], parts["x_load"]), parts["b"], parts["load"], parts["r"])


def top_features(export: dict[str, DataFrame], k: int = 30) -> DataFrame:
    """The `k` features of each component with the largest weights, from the distributed table."""
    return topk_features(export["x_weights"].withColumn("position", F.xxhash64("feature")), ["component"], k)


def wide_stratified(
    blocks: DataFrame,
    rows: DataFrame,
    grid: DataFrame,
    group: str = "grp",
    names: tuple[str, str] = ("case", "control"),
    n_components: int = 10,
    scales: str = "train",
    subject: str = "subject_id",
) -> DataFrame:
    """`coupling.stratified_coupling` with a wide first view: the grid of both groups from one pass, the best configurations compared on single features.

    rows: (subject, fold, c, b, group). The weights of each group's best configuration are mapped back to the features, where their cosine is taken.
    """
    results = dual_grid(blocks, rows, grid, [group], n_components, scales, subject)
    best = reports.best_config(results, [group]).persist()
    configs = {r[group]: r.asDict() for r in best.collect()}  # one row per group
    exports = {g: wide_export(blocks, rows.where(F.col(group) == g), c["method"], c["dim"], c["c1"], c["c2"], 1, subject=subject) for g, c in configs.items()}

    def cosine(part: str, on: list[str]) -> DataFrame:
        a, b = (exports[g][part].select(*on, "weight") for g in names)
        return cosine_similarity(a, b, on).select("cosine")

    def of(name: str, c: str):
        return F.max(F.when(F.col(group) == name, F.col(c)))

    case, control = names
    return best.agg(
        of(case, "config").alias("case_config"), of(control, "config").alias("control_config"), of(case, "r_holdout").alias("r_case"),
        of(control, "r_holdout").alias("r_control"), (of(case, "r_holdout") - of(control, "r_holdout")).alias("r_diff"),
    ).withColumns({"x_weight_cosine": cosine("x_weights", ["feature", "component"]).scalar(), "y_weight_cosine": cosine("y_weights", ["position", "component"]).scalar()})


def fold_rows(blocks: DataFrame, rows: DataFrame, dim: int, scope: str = "fold", subject: str = "subject_id") -> tuple[DataFrame, Layout]:
    """(subset, subject_id, fold, y, z) with z = [1, covariates, components, second view]: the components of the fold `subset`, for its training and tested rows.

    scope "fold" fits every fold's own components, all in one pass; "train" fits those of the whole training part, and `subset` is -1 throughout.
    """
    if scope not in ("fold", "train"):
        raise ValueError(f"scope must be fold or train, got {scope!r}")
    if own := primal(blocks, rows, ["fold", "y"], subject):
        return _primal_fold_rows(own, dim, scope)
    subjects = read_subjects(rows, columns=["fold", "y"], subject=subject)
    subsets, labels = fold_subsets(subjects)
    if scope == "train":
        subsets = [s for s, label in zip(subsets, labels) if label[0] == HOLDOUT]
        if not subsets:
            raise ValueError(_NO_HOLDOUT)
    width = _width(subjects, subsets, dim)
    fold, y = subjects.columns["fold"], subjects.columns["y"]

    def emitted(s: Subset, pca: DualPCA) -> pa.Table:
        scores = np.zeros((len(pca.scores), width))
        scores[:, : pca.scores.shape[1]] = pca.scores
        z = np.hstack([subjects.c[s.rows], scores, subjects.y[s.rows]])
        offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
        return pa.table(
            {
                "subset": pa.array(np.full(len(z), labels[s.key][0]), pa.int32()), "subject_id": pa.array(subjects.ids[s.rows].tolist(), pa.string()), "fold": pa.array(fold[s.rows], pa.int32()),
                "y": pa.array(y[s.rows], pa.int32()), "z": pa.ListArray.from_arrays(offsets, pa.array(z.ravel())),
            }
        )

    layout = dual_layout(blocks, subjects, subject)
    got = solve_subsets(layout, subjects, subsets, emitted, "subset int, subject_id string, fold int, y int, z array<double>", width)
    return held(got), Layout(subjects.c.shape[1] - 1, width, subjects.y.shape[1])


_NO_HOLDOUT = "the components of the training part come with the holdout's; there is none"


def _primal_fold_rows(own: Primal, dim: int, scope: str) -> tuple[DataFrame, Layout]:
    """`fold_rows` from the features' side."""
    layout, cells = own.layout, fold_moments(own)
    if scope == "train":
        cells = cells.where(F.col("fold") == HOLDOUT)
        if cells.isEmpty():
            raise ValueError(_NO_HOLDOUT)
    width = _primal_width(cells, layout, dim)

    def mapped(key: tuple, train: np.ndarray, _: np.ndarray) -> pa.Table:
        return _named({str(key[0]): component_map(train, layout, width)[0]})

    maps = {int(fold): t for fold, t in _matrices(solved(cells, ["fold"], layout.dim, mapped, _NAMED)).items()}  # features x components per fold

    def run(batches):
        for batch in batches:
            z, fold = matrix(batch.column("z"), finite=True), batch.column("fold").to_numpy()
            for f, t in maps.items():
                rows = np.flatnonzero((fold == f) | (fold != HOLDOUT))
                got = z[rows] @ t
                side = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]), pa.array(got.ravel()))
                kept = [batch.column(c).take(pa.array(rows)) for c in ("subject_id", "fold", "y")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), f), pa.int32()), *kept, side], names=["subset", "subject_id", "fold", "y", "z"])

    ints = [F.col(c).cast("int").alias(c) for c in ("fold", "y")]
    got = own.rows.select("subject_id", *ints, "z").mapInArrow(run, "subset int, subject_id string, fold int, y int, z array<double>")
    return held(got), Layout(layout.n_cov, width, layout.q)


def wide_scores(
    blocks: DataFrame,
    rows: DataFrame,
    dim: int,
    representations: Sequence[str] = suite.REPRESENTATIONS,
    classifiers: Sequence[str] = ("logreg",),
    k: int = 10,
    c1: float = 0.3,
    c2: float = 0.3,
    scope: str = "fold",
    hidden: Sequence[int] = (64, 32),
    mlp_iter: int = 200,
    seed: int = 42,
    subject: str = "subject_id",
) -> DataFrame:
    """`suite.cross_validated_scores` with a wide first view: (subject_id, y, fold, split, model, score, yhat).

    rows: (subject, fold, y, c, b). With scope "fold" every fold is scored through `dim` components of its own training rows, the holdout through those of the whole
    training part; all come from one pass over the blocks and all logistic models from joint Newton passes.
    """
    data, layout = fold_rows(blocks, rows, dim, scope, subject)
    mats: dict = {}
    for (subset, fold), m in collect_moments(moments(data, ["subset", "fold"], F.concat("z", F.array(F.col("y").cast("double")))), ["subset", "fold"]).items():
        mats.setdefault(subset, {})[fold] = m
    tested = sorted(mats) if scope == "fold" else sorted(mats[HOLDOUT])
    models, base = [], None
    if scope == "train":  # preparation as well is that of the whole training part
        base = solve.linear_prep(sum(part for fold, part in mats[HOLDOUT].items() if fold != HOLDOUT)[:-1, :-1], layout)
    for f in tested:
        own = mats[f] if scope == "fold" else mats[HOLDOUT]
        m = sum(part for fold, part in own.items() if fold not in (f, HOLDOUT))
        pos, m = float(m[0, -1]), m[:-1, :-1]
        for name in representations:
            w = suite.representation_map(name, m, layout, None, k, c1, c2, base)
            models.append(FoldModel(name, f, scaled_map(m, w), balanced_weights(m[0, 0], pos)))
    train = data if scope == "fold" else data.drop("subset")
    test = data.where("subset = fold") if scope == "fold" else data
    parts = []
    for classifier in classifiers:
        got = suite.fitted_scores(train, test, models, classifier, ["subject_id", "y"], hidden, mlp_iter, seed)
        parts.append(got.withColumn("model", F.concat(F.col("model"), F.lit(f"_{classifier}"))))
    return reports.union_results(*parts).withColumn("split", F.when(F.col("fold") == HOLDOUT, "holdout").otherwise("cv"))


def wide_suite(blocks: DataFrame, rows: DataFrame, dim: int, **options) -> DataFrame:
    """AUC and average precision of every representation and classifier: `suite.predictive_suite` with a wide first view."""
    return suite.suite_metrics(wide_scores(blocks, rows, dim, **options))


def wide_sparse(
    blocks: DataFrame,
    rows: DataFrame,
    k: int,
    c1: float = 0.3,
    c2: float = 0.3,
    cv: bool = True,
    top: int = 10,
    subject: str = "subject_id",
    **options,
) -> dict[str, DataFrame]:
    """`interpretable.interpretable_scca` of feature blocks without PCA: sparse weights on the single features.

    `folds` (fold, component, r_train, r_val, sparsity_x, sparsity_y), fold -1 being the final fit on the training part scored on the holdout, with `cv` also every
    fold; `x_weights` (gene, dim, feature, component, weight, loading), distributed; `y_weights` (position, component, weight); `top_x_weights`, `top_x_loadings`.
    `options` go to `block_scca.block_scca`.
    """
    spark = rows.sparkSession
    if own := primal(blocks, rows, ["fold"], subject):
        return _primal_sparse(own, k, c1, c2, cv, top, **options)
    subjects = read_subjects(rows, columns=["fold"], subject=subject)
    layout = dual_layout(blocks, subjects, subject)
    subsets, labels = fold_subsets(subjects)
    if HOLDOUT not in (label[0] for label in labels):
        subsets.append(Subset(len(subsets), np.arange(subjects.n), np.zeros(0, np.int64)))
        labels.append((HOLDOUT,))
    table, final, own = [], None, None
    for subset, (fold,) in zip(subsets, labels):
        if fold != HOLDOUT and not cv:
            continue
        fit = block_scca(layout, subjects, subset, k, c1, c2, **options)
        dense = (np.abs(fit.v) < 1e-12).mean(axis=0)
        table += [(int(fold), c, float(fit.r_train[c]), float(np.nan_to_num(fit.r_score[c])), float(fit.sparsity[c]), float(dense[c])) for c in range(k)]
        if fold == HOLDOUT:
            final, own = fit, subset
    n = len(own.train)
    loads = block_maps(layout, subjects, own.train, np.zeros((n, k)), final.variates_x[:n], options.get("standardize", True)).select("block", "dim", "component", "loading")
    x = final.table().join(loads, ["block", "dim", "component"])
    x = x.select(F.col("block").alias("gene"), "dim", F.concat_ws("_", "block", "dim").alias("feature"), "component", "weight", "loading")
    return _sparse_tables(table, x, final.v, top)


def _sparse_tables(table: list[tuple], x: DataFrame, weights: np.ndarray, top: int) -> dict[str, DataFrame]:
    spark = x.sparkSession
    placed = x.withColumn("position", F.xxhash64("feature"))
    v = [(f, c, float(weights[f, c])) for f in range(weights.shape[0]) for c in range(weights.shape[1])]
    return {
        "folds": spark.createDataFrame(table, "fold int, component int, r_train double, r_val double, sparsity_x double, sparsity_y double"),
        "x_weights": x,
        "y_weights": spark.createDataFrame(v, "position int, component int, weight double"),
        "top_x_weights": topk_features(placed, ["component"], top).drop("position"),
        "top_x_loadings": topk_features(placed, ["component"], top, weight="loading").drop("position"),
    }


def _primal_sparse(own: Primal, k: int, c1: float, c2: float, cv: bool, top: int, projection: str = "raw", max_iter: int = 500, tol: float = 1e-6, standardize: bool = True) -> dict[str, DataFrame]:
    """`wide_sparse` from the features' side: `solve.scca` of the cross-covariance of the prepared views."""
    layout = own.layout
    cells = held(_train_and_holdout(own))
    if cv:
        cells = cells.unionByName(fold_moments(own).where(F.col("fold") != HOLDOUT), allowMissingColumns=True)

    def fitted(key: tuple, train: np.ndarray, score: np.ndarray) -> pa.Table:
        w, p = prepared(train, layout, standardize)[0], layout.p
        n, _, cov = solve.covariance(train, w)
        a, b = solve.scca(cov[:p, p:], k, c1, c2, projection=projection, max_iter=max_iter, tol=tol)
        own_r = solve.pair_correlations(cov[:p, :p], cov[:p, p:], cov[p:, p:], a, b)
        far = solve.covariance(score, np.hstack([w[:, :p] @ a, w[:, p:] @ b]))[2]
        eye = np.eye(k)
        r = solve.pair_correlations(far[:k, :k], far[:k, k:], far[k:, k:], eye, eye)
        named = {"r": np.stack([own_r, r, (np.abs(a) < 1e-12).mean(axis=0), (np.abs(b) < 1e-12).mean(axis=0)])}
        if key[0] == HOLDOUT:
            named |= {"a": a, "b": b, "load": solve.loadings(cov[:p, :p], a, n)}
        return _named({f"{key[0]} {name}": m for name, m in named.items()})

    parts = _matrices(solved(cells, ["fold"], layout.dim, fitted, _NAMED))  # features x components at most
    table = [(int(name.split()[0]), c, float(m[0, c]), float(np.nan_to_num(m[1, c])), float(m[2, c]), float(m[3, c])) for name, m in parts.items() if name.endswith(" r") for c in range(k)]
    final = {name: parts[f"{HOLDOUT} {name}"] for name in ("a", "b", "load")}
    return _sparse_tables(table, _feature_table(own, final["a"], final["load"]), final["b"], top)
