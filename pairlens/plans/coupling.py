"""Cross-validated coupling grids from one pass over the data.

`split_moments` reads the rows once. Everything after it works on moment matrices:
each (group, fold, share of the grid) is one task that fits its configurations on
total-minus-fold and scores them on the fold, or on the holdout for the final fit.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.labels import config_label
from pairlens.operators import reports, solve
from pairlens.operators.block_pca import block_layout, fit_blocks, score_blocks
from pairlens.operators.interpret import cosine_similarity
from pairlens.operators.moments import MAX_DIM, Layout, collect_moments, matrix_from_cells, moments, z_vector
from pairlens.operators.splits import holdout_and_folds
from pairlens.session import held

HOLDOUT = -1


def assign_splits(
    df: DataFrame,
    n_folds: int = 5,
    fraction: float = 0.2,
    seed: int = 42,
    id_col: str = "subject_id",
    label: str | None = "y",
    group: str | None = None,
) -> DataFrame:
    """Add `fold`: -1 for the holdout, else the validation fold of a training row."""
    return holdout_and_folds(df, n_folds, fraction, seed, id_col, label, group, HOLDOUT)


def split_moments(df: DataFrame, z: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Moments per (keys..., fold): the only data-sized step of a grid."""
    return moments(df, [*keys, "fold"], z)


def materialize_moments(
    mom: DataFrame, path: str, keys: Sequence[str] = (), fingerprint: str | None = None, folds: Sequence[int] | None = None
) -> DataFrame:
    """Moments kept at `path`, partitioned by key and fold.

    What is there and finished is read back; a half-written table is written anew. With `folds`, those that are absent are computed from
    `mom` and added, the others are not computed again. `fingerprint` (for instance of `results.dataset_fingerprint`
    and the settings) is kept beside the moments; a table of another fingerprint is an error, not served.
    """
    spark = mom.sparkSession
    mark = f"{path}-finished"  # written last: what it does not name may be incomplete
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{mark}/_SUCCESS")
    state = {}
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        state = json.loads(spark.read.text(mark).first()[0])
        if state["fingerprint"] != fingerprint:
            raise ValueError(f"{path} holds moments of other data or settings: {state['fingerprint']}, wanted {fingerprint}")
    absent = None if folds is None else [f for f in folds if f not in state.get("folds", [])]
    if not state or absent:
        rows = mom if absent is None else mom.filter(F.col("fold").isin(absent))
        rows.write.partitionBy(*keys, "fold").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        there = spark.read.schema(mom.schema).parquet(path).select("fold").distinct().collect() if absent is None else []
        done = sorted({*state.get("folds", []), *(absent or []), *(r[0] for r in there)})
        spark.createDataFrame([(json.dumps({"fingerprint": fingerprint, "folds": done}),)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return spark.read.schema(mom.schema).parquet(path)


def total_minus_fold(mom: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., fold, i, j, s_train, s_eval): training and evaluation moments of every fold and the holdout."""
    w = Window.partitionBy(*keys, "i", "j")  # one row per fold
    total = F.sum(F.when(F.col("fold") != HOLDOUT, F.col("s")).otherwise(0.0)).over(w)
    s_train = F.when(F.col("fold") == HOLDOUT, total).otherwise(total - F.col("s"))
    return mom.select(*keys, "fold", "i", "j", s_train.alias("s_train"), F.col("s").alias("s_eval"))


def run_grid(
    mom: DataFrame,
    layout: Layout,
    grid: DataFrame,
    keys: Sequence[str] = (),
    n_components: int = 10,
    **options,
) -> DataFrame:
    """Grid scores from moments per (keys..., fold); see `grid_on_cells`."""
    return grid_on_cells(total_minus_fold(mom, keys), layout, grid, keys, n_components, **options)


def grid_on_cells(
    train_eval: DataFrame,
    layout: Layout,
    grid: DataFrame,
    keys: Sequence[str] = (),
    n_components: int = 10,
    residualize: bool = True,
    reduced: bool = False,
    shares: int = 4,
    **options,
) -> DataFrame:
    """First-component train and evaluation correlation of every (keys..., fold, configuration).

    `train_eval` has (keys..., fold, i, j, s_train, s_eval). Fold -1 carries the holdout
    result of the final fit. A configuration that fails is recorded with its error and
    does not stop the others. `reduced` as in `PairModel`.
    """
    keys = list(keys)
    if layout.dim > MAX_DIM:
        raise ValueError("too many features for a moment grid; use block_pca first")
    configs = [r.asDict() for r in grid.orderBy("position").collect()]  # a few hundred rows at most
    max_dim = max(c["dim"] for c in configs)
    # Neighbouring configurations go to different shares, which evens out slow and fast methods.
    lots = [configs[i::shares] for i in range(min(shares, len(configs)))]
    cells = train_eval.withColumn("_lot", F.explode(F.array(*[F.lit(i) for i in range(len(lots))])))
    schema = T.StructType(
        [train_eval.schema[k] for k in keys]
        + [
            T.StructField("fold", train_eval.schema["fold"].dataType),
            T.StructField("position", T.IntegerType()),
            T.StructField("k", T.IntegerType()),
            T.StructField("r_train", T.DoubleType()),
            T.StructField("r_eval", T.DoubleType()),
            T.StructField("n_train", T.LongType()),
            T.StructField("n_eval", T.LongType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def fit_lot(pdf):
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        train = matrix_from_cells(i, j, pdf["s_train"], layout.dim)
        held = matrix_from_cells(i, j, pdf["s_eval"], layout.dim)
        head = {c: pdf[c].iloc[0] for c in [*keys, "fold"]}
        try:
            model, failure = solve.PairModel(train, layout, max_dim, residualize, reduced), None
        except Exception as err:  # recorded per configuration below
            model, failure = None, str(err)
        out = []
        for c in lots[int(pdf["_lot"].iloc[0])]:
            row = {**head, "position": c["position"], "k": 0, "r_train": None, "r_eval": None, "error": failure}
            row["n_train"], row["n_eval"] = int(round(train[0, 0])), int(round(held[0, 0]))
            if failure is None:
                try:
                    fit = model.fit(c["method"], c["dim"], n_components, c["c1"], c["c2"], **options)
                    r_eval = model.score(fit, held)
                    row.update(k=len(r_eval), r_train=float(np.nan_to_num(fit.r_train[0])), r_eval=float(np.nan_to_num(r_eval[0])))
                except Exception as err:
                    row["error"] = str(err)
            out.append(row)
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    scores = cells.groupBy(*keys, "fold", "_lot").applyInPandas(fit_lot, schema)
    named = grid.select("position", "method", "dim", "c1", "c2", config_label("method", "dim", "c1", "c2").alias("config"))
    return scores.join(named, "position")


def grid_results(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per configuration: CV means, gaps and holdout. Failed ones keep NULL metrics and the error."""
    by = [*keys, "position", "config", "method", "dim", "c1", "c2"]
    cv = F.col("fold") != HOLDOUT

    def over_cv(c: str) -> Column:
        return F.when(cv, F.col(c))

    def on_holdout(c: str) -> Column:
        return F.max(F.when(~cv, F.col(c)))

    failed = F.max("error").isNotNull()
    rows = scores.groupBy(*by).agg(
        F.when(~failed, F.avg(over_cv("r_train"))).alias("mean_train"),
        F.when(~failed, F.avg(over_cv("r_eval"))).alias("mean_val"),
        F.when(~failed, F.stddev_pop(over_cv("r_eval"))).alias("std_val"),
        F.when(~failed, F.avg(over_cv("r_train")) - F.avg(over_cv("r_eval"))).alias("overfitting_gap"),
        on_holdout("r_train").alias("r_train_final"),
        on_holdout("r_eval").alias("r_holdout"),
        (on_holdout("r_train") - on_holdout("r_eval")).alias("generalization_gap"),
        F.max("error").alias("error"),
    )
    return rows


def coupling_grid(
    df: DataFrame,
    z: Column,
    layout: Layout,
    grid: DataFrame,
    keys: Sequence[str] = (),
    n_components: int = 10,
    completed: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Results of every configuration not yet in `completed`, together with the completed ones."""
    todo = resume_grid(grid, completed)
    if completed is not None and todo.isEmpty():
        return completed
    fresh = grid_results(run_grid(split_moments(df, z, keys), layout, todo, keys, n_components, **options), keys)
    return fresh if completed is None else completed.unionByName(fresh, allowMissingColumns=True)


def wide_coupling_grid(
    blocks: DataFrame,
    rows: DataFrame,
    n_cov: int,
    q: int,
    grid: DataFrame,
    n_components: int = 10,
    subject: str = "subject_id",
    pca_options: dict | None = None,
    **options,
) -> DataFrame:
    """Grid whose first view is too wide for moments: block PCA refitted per fold.

    `blocks` is (subject, gene, embedding); `rows` is (subject, fold, c, b) with
    covariates and second view. The blocks are shuffled once; every fold adds its PCA
    passes, on its training rows only, and one moment pass over its scores.
    """
    top = grid.agg(F.max("dim")).first()[0]
    rows = held(rows)
    folds = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    covariates = rows.select(subject, F.col("c").alias("covariates"), "fold")
    layout_df = held(block_layout(blocks, covariates, subject, tag=F.col("fold")))
    parts, width = [], None
    for fold in folds:
        train = ~F.col("tag").isin(fold, HOLDOUT)
        model = fit_blocks(layout_df, top, train, **(pca_options or {}))
        width = min(len(model.eigenvalues), width or top)
        pcs = F.slice("pcs", 1, width)
        scored = score_blocks(layout_df, model, subject).join(rows, subject)
        part = F.when(F.col("fold") == fold, "eval").when(F.col("fold") != HOLDOUT, "train")
        scored = scored.withColumn("_part", part).filter("_part is not null")
        mom = moments(scored, ["_part"], z_vector(F.col("c"), pcs, F.col("b")))
        cell = {p: F.sum(F.when(F.col("_part") == p, F.col("s")).otherwise(0.0)).alias(f"s_{p}") for p in ("train", "eval")}
        parts.append(mom.groupBy("i", "j").agg(cell["train"], cell["eval"]).select(F.lit(fold).cast("int").alias("fold"), "i", "j", "s_train", "s_eval"))
    cells = reports.union_results(*parts)
    layout = Layout(n_cov, width, q)
    return grid_results(grid_on_cells(cells, layout, grid, n_components=n_components, reduced=True, **options))


def resume_grid(grid: DataFrame, completed: DataFrame | None) -> DataFrame:
    """Configurations still to run; finished ones stay part of the later choice of the best."""
    if completed is None:
        return grid
    label = config_label("method", "dim", "c1", "c2")
    return grid.withColumn("config", label).join(completed.select("config").distinct(), "config", "left_anti").drop("config")


def refit_best(
    mom: DataFrame, layout: Layout, best: DataFrame, keys: Sequence[str], n_components: int = 1, residualize: bool = True
) -> dict[tuple, tuple[solve.PairModel, solve.Fit]]:
    """Refit the best configuration of every key on its whole training part."""
    keys = list(keys)
    train = mom.filter(F.col("fold") != HOLDOUT).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))
    mats = collect_moments(train, keys)
    out = {}
    for row in best.collect():  # one row per key
        key = tuple(row[k] for k in keys)
        model = solve.PairModel(mats[key], layout, row["dim"], residualize)
        out[key] = (model, model.fit(row["method"], row["dim"], n_components, row["c1"], row["c2"]))
    return out


def weight_table(spark, fits: dict[tuple, tuple[solve.PairModel, solve.Fit]], keys: Sequence[str], padded: bool = False) -> DataFrame:
    """(keys..., view, feature, component, weight) rows of fitted models.

    View x is mapped back from component space to its features, so groups are compared
    in one basis; `padded` keeps the component-space weights instead.
    """
    rows = []
    for key, (_, fit) in fits.items():
        wx = fit.a if padded or fit.x_components is None else fit.x_components @ fit.a
        for view, w in (("x", wx), ("y", fit.b)):
            rows += [(*key, view, f, c, float(w[f, c])) for f in range(w.shape[0]) for c in range(w.shape[1])]
    kinds = ", ".join(f"{k} string" for k in keys)
    return spark.createDataFrame(
        [tuple(str(v) if i < len(keys) else v for i, v in enumerate(r)) for r in rows],
        f"{kinds + ', ' if kinds else ''}view string, feature int, component int, weight double",
    )


def stratified_coupling(
    df: DataFrame,
    z: Column,
    layout: Layout,
    grid: DataFrame,
    group: str = "grp",
    names: tuple[str, str] = ("case", "control"),
    n_components: int = 10,
    padded: bool = False,
    cache_path: str | None = None,
) -> DataFrame:
    """Grid per group, best configuration by CV mean, and the comparison of both groups.

    With `cache_path` the fold moments are written there once; later calls with other
    grids start from them and never read the rows again.
    """
    spark = df.sparkSession
    mom = split_moments(df, z, [group])
    mom = materialize_moments(mom, cache_path, [group]) if cache_path else held(mom)
    results = grid_results(run_grid(mom, layout, grid, [group], n_components), [group])
    best = reports.best_config(results, [group]).persist()
    fits = refit_best(mom, layout, best, [group])
    weights = weight_table(spark, fits, [group], padded)

    def cosine(view: str) -> DataFrame:
        a, b = (weights.filter((F.col(group) == g) & (F.col("view") == view)) for g in names)
        return cosine_similarity(a, b, ["feature", "component"]).select("cosine")

    def of(name: str, c: str) -> Column:
        return F.max(F.when(F.col(group) == name, F.col(c)))

    case, control = names
    return best.agg(
        of(case, "config").alias("case_config"),
        of(control, "config").alias("control_config"),
        of(case, "r_holdout").alias("r_case"),
        of(control, "r_holdout").alias("r_control"),
        (of(case, "r_holdout") - of(control, "r_holdout")).alias("r_diff"),
    ).withColumns({"x_weight_cosine": cosine("x").scalar(), "y_weight_cosine": cosine("y").scalar()})
