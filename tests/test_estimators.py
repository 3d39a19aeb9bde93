"""Permutation tests, classifiers and grids on planted data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.operators import classify, linear, permutation, reports
from pairlens.operators.moments import Layout, collect_moments, moments, z_vector
from pairlens.plans import coupling, suite

RNG = np.random.default_rng(4)
LAYOUT = Layout(1, 5, 4)


@pytest.fixture(scope="module")
def planted(spark):
    n = 300
    t = RNG.standard_normal(n)
    x, y = RNG.standard_normal((n, 5)), RNG.standard_normal((n, 4))
    x[:, 0] += 1.5 * t
    y[:, 1] += 1.5 * t
    age = RNG.standard_normal(n)
    lab = (x[:, 1] + 0.8 * RNG.standard_normal(n) > 0).astype(int)
    pdf = pd.DataFrame({"subject_id": [f"s{i:03d}" for i in range(n)], "y": lab, "c": [[a] for a in age], "x": list(x), "b": list(y)})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def z():
    return z_vector(F.col("c"), F.col("x"), F.col("b"))


def test_row_permutations_separate_signal_from_noise(spark, planted):
    _, df = planted
    obs, null = permutation.permutation_null_rows(df, z(), LAYOUT, 99, 1, perms_per_task=40)
    r = null.toPandas()["r"]
    assert len(r) == 99 and (r < obs[0]).all()


def test_permutations_equal_direct_refits(spark, planted):
    pdf, df = planted
    _, null = permutation.permutation_null_rows(df, z(), LAYOUT, 3, 2, seed=11)
    got = null.toPandas().pivot(index="perm_id", columns="component", values="r").to_numpy()
    c = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["c"])])
    res = lambda f: f - c @ np.linalg.lstsq(c, f, rcond=None)[0]
    x, y = res(np.vstack(pdf["x"])), res(np.vstack(pdf["b"]))
    places = permutation.numbered(df.select("subject_id"), "subject_id", 11).toPandas().set_index("subject_id")["_pos"]
    number = places.loc[pdf["subject_id"]].to_numpy()
    for b in range(3):
        turn = np.empty(len(x), int)
        turn[permutation.permuted(number, len(x), 11, b)] = np.arange(len(x))
        qx, qy = np.linalg.qr(x[np.argsort(number)])[0], np.linalg.qr(y[turn])[0]
        assert np.allclose(got[b], np.linalg.svd(qx.T @ qy, compute_uv=False)[:2], atol=1e-8)


def test_null_does_not_depend_on_blocks(spark, planted):
    _, df = planted
    nulls = [permutation.permutation_null_rows(df, z(), LAYOUT, 20, 2, block_rows=rows, perms_per_task=perms)[1].toPandas().sort_values(["perm_id", "component"])["r"].to_numpy() for rows, perms in ((10**6, 20), (60, 7), (7, 1))]
    assert len(nulls[0]) == 40 and np.allclose(nulls[0], nulls[1]) and np.allclose(nulls[0], nulls[2])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permuted_is_a_bijection_without_bias(n):
    turns = np.array([permutation.permuted(np.arange(n), n, 5, b) for b in range(400)])
    assert (np.sort(turns, axis=1) == np.arange(n)).all()
    assert abs(turns[:, 0].mean() - (n - 1) / 2) < 0.2 * n + 1e-9
    for b in range(5):
        assert (permutation.origin(turns[b], n, 5, b) == np.arange(n)).all()


def test_y_travels_once_per_wave():
    """4,218 rows and 1,000 permutations on 8 cores: 8 waves; at 5 million rows fewer than a third of the permutations."""
    for n, p, q, most in ((4218, 512, 136, 8 * 4), (5_000_000, 100, 100, 320)):
        rows, perms = permutation.waves(n, 1000, p, q, 8)
        assert -(-n // rows) * -(-1000 // perms) <= most
        assert rows * p <= permutation.TASK_CELLS and perms * p * q <= permutation.TASK_CELLS and perms * min(rows, n) <= permutation.TASK_CELLS


@pytest.mark.parametrize("vector,message", [(None, "are null"), ([1.0, None, 2.0], "values"), ([1.0], "different lengths"), ([1.0, float("nan"), 2.0], "NaN")])
def test_broken_vectors_are_errors(spark, vector, message):
    df = spark.createDataFrame([(i, [1.0, 2.0, float(i)]) for i in range(9)] + [(9, vector)], "id long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match=message):
        linear.moment_matrix(df, F.col("v"))


def test_group_null_resumes(spark, planted):
    _, df = planted
    args = dict(z=z(), layout=LAYOUT, method="cca", pca_dim=3)
    part = permutation.permutation_null_groups(df, n_perm=6, **args).cache()
    full = permutation.permutation_null_groups(df, n_perm=10, completed=part, **args).toPandas().sort_values("perm_id")
    fresh = permutation.permutation_null_groups(df, n_perm=10, **args).toPandas().sort_values("perm_id")
    assert list(full["perm_id"]) == list(range(10)) and np.allclose(full["diff"], fresh["diff"])


def test_small_groups_score_zero(spark, planted):
    _, df = planted
    few = df.limit(12).withColumn("y", (F.col("subject_id") == "none").cast("int"))
    got = permutation.permutation_null_groups(few, z(), LAYOUT, 2, "cca", 2).toPandas()
    assert (got["r_case"] == 0).all()


def test_perm_p_value_rule(spark):
    null = spark.range(1000).select((F.col("id") < 39).cast("double").alias("r"))
    obs = spark.createDataFrame([(0.5,)], "r_obs double")
    assert abs(reports.perm_pvalue(null, obs, []).first()["p_value"] - 40 / 1001) < 1e-12


def test_logistic_equals_spark_ml(spark, planted):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    _, df = planted
    rows = coupling.assign_splits(df, n_folds=3).cache()
    zr = suite._rows(rows, z(), ["subject_id", "y"])
    mats, pos = suite.fold_matrices(zr)
    models = suite.build_models(mats, pos, LAYOUT, ["early_fusion"], None, 3, 0.3, 0.3)
    classify.fit_logistic(zr, models)
    m = next(m for m in models if m.fold == 1)
    feats = linear.project(zr, "z", {"f": m.w[:, 1:]}, ["y", "fold"]).filter(~F.col("fold").isin(1, -1))
    n = feats.count()
    train = feats.select(
        array_to_vector("f").alias("features"), F.col("y").cast("double").alias("label"), F.when(F.col("y") == 1, m.class_weight[1]).otherwise(m.class_weight[0]).alias("w")
    )
    ml = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, weightCol="w", standardization=False, maxIter=200, tol=1e-12).fit(train)
    assert np.allclose(m.beta[1:], ml.coefficients.toArray(), atol=1e-4) and abs(m.beta[0] - ml.intercept) < 1e-4


def test_no_model_sees_the_holdout(spark, planted):
    _, df = planted
    rows = coupling.assign_splits(df, n_folds=3).cache()
    spoiled = rows.withColumn("y", F.when(F.col("fold") == -1, 1 - F.col("y")).otherwise(F.col("y")))
    run = lambda d: suite.cross_validated_scores(d, z(), LAYOUT, suite.REPRESENTATIONS, pca_dim=3, k=2).select("subject_id", "model", "score").toPandas()
    a, b = (run(d).sort_values(["subject_id", "model"])["score"].to_numpy() for d in (rows, spoiled))
    assert np.allclose(a, b, atol=1e-9)


def test_suite_finds_the_planted_view(spark, planted):
    _, df = planted
    got = suite.predictive_suite(coupling.assign_splits(df), z(), LAYOUT, k=3).toPandas().set_index(["model", "split"])["auc"]
    assert got["gene_only_logreg", "cv"] > 0.8 and got["fmri_only_logreg", "cv"] < 0.65


def test_grid_finds_the_coupling_and_records_failures(spark, planted):
    _, df = planted
    rows = coupling.assign_splits(df)
    grid = reports.config_grid(spark, ["cca", "scca"], [2, 5], [0.3], 5)
    bad = spark.createDataFrame([(99, "nope", 5, 1.0, 1.0)], grid.schema)
    got = coupling.coupling_grid(rows, z(), LAYOUT, grid.unionByName(bad)).toPandas().set_index("position")
    assert "unknown method" in got.loc[99, "error"] and np.isnan(got.loc[99, "mean_val"])
    good = got.drop(index=99)
    assert good["error"].isna().all() and good.loc[good["dim"] == 5, "mean_val"].max() > 0.4


def test_resumed_grid_keeps_finished_results(spark, planted):
    _, df = planted
    rows = coupling.assign_splits(df).cache()
    grid = reports.config_grid(spark, ["cca", "scca"], [2, 5], [0.3, 0.5], 5)
    full = coupling.coupling_grid(rows, z(), LAYOUT, grid).toPandas().set_index("config")["mean_val"]
    done = coupling.coupling_grid(rows, z(), LAYOUT, grid.filter("position < 4")).cache()
    again = coupling.coupling_grid(rows, z(), LAYOUT, grid, completed=done).toPandas().set_index("config")["mean_val"]
    assert again.to_dict() == pytest.approx(full.to_dict())
    assert coupling.coupling_grid(rows, z(), LAYOUT, grid.filter("position < 4"), completed=done) is done


def test_moments_survive_any_partitioning(spark, planted):
    pdf, df = planted
    mat = np.column_stack([np.ones(len(pdf)), np.vstack(pdf["c"]), np.vstack(pdf["x"]), np.vstack(pdf["b"])])
    for parts in (1, 13):
        got = collect_moments(moments(df.repartition(parts), ["y"], z()), ["y"])
        for lab in (0, 1):
            rows = mat[pdf["y"] == lab]
            assert np.allclose(got[(lab,)], rows.T @ rows)


def test_size_guards(spark, planted, monkeypatch):
    _, df = planted
    monkeypatch.setattr(linear, "MAX_MAP_CELLS", 3)
    with pytest.raises(ValueError, match="too large"):
        linear.project(df, z(), {"u": np.zeros((11, 2))}, ["subject_id"])


def test_cached_moments_are_checked_and_completed(spark, tmp_path):
    def rows(shift, folds):
        df = spark.createDataFrame([(i, f, float(i) + shift) for i in range(12) for f in folds], "id long, fold int, v double")
        return coupling.split_moments(df, z_vector(None, F.array("v")))

    def sums(df):
        return {r["fold"]: r["s"] for r in df.where("i = 0 and j = 1").collect()}

    path = f"file://{tmp_path}/moments"
    first = sums(coupling.materialize_moments(rows(0, [0, 1]), path, fingerprint="a", folds=[0, 1]))
    assert first == {0: 66.0, 1: 66.0}
    more = sums(coupling.materialize_moments(rows(1, [0, 1, 2]), path, fingerprint="a", folds=[0, 1, 2]))
    assert more == {0: 66.0, 1: 66.0, 2: 78.0}
    with pytest.raises(ValueError, match="other data"):
        coupling.materialize_moments(rows(1, [0]), path, fingerprint="b")
    (tmp_path / "moments-finished" / "_SUCCESS").unlink()
    assert sums(coupling.materialize_moments(rows(2, [0, 1, 2]), path, fingerprint="b")) == {0: 90.0, 1: 90.0, 2: 90.0}


def test_unfinished_fits_are_errors(spark, planted):
    _, df = planted
    rows = coupling.assign_splits(df)
    with pytest.raises(RuntimeError, match="not converged"):
        frame = rows.select("fold", "y", z().alias("z"))
        model = classify.FoldModel("m", 0, np.eye(LAYOUT.dim)[:, : 1 + LAYOUT.n_cov + LAYOUT.p], (1.0, 1.0))
        classify.fit_logistic(frame, [model], max_iter=1)
