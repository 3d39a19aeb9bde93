"""The dual of wide views against NumPy refits and against block PCA."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_whole_views import arrays, cv, first_pair, prepared, values

from pairlens.catalog import estimators
from pairlens.operators import block_pca as bp
from pairlens.operators import dual, reports
from pairlens.operators.splits import split_by_label
from pairlens.plans import coupling, wide


def blocks_of(rows, width=8):
    """The first view in blocks of `width` values."""
    parts = F.expr(f"transform(sequence(0, cast(size(x) / {width} as int) - 1), i -> struct(concat('g', i) as gene, slice(x, i * {width} + 1, {width}) as embedding))")
    return rows.select("subject_id", F.inline(parts))


@pytest.fixture(scope="module")
def rows(spark):
    return coupling.assign_splits(estimators.pairs(spark, SF)).select("subject_id", "y", "fold", "c", "x", "b").persist()


@pytest.fixture(scope="module")
def wide_rows(spark):
    """60 subjects, 400 features with a planted common signal: more features than subjects, one of them constant."""
    rng = np.random.default_rng(4)
    signal = rng.normal(size=(60, 3))
    x = signal @ rng.normal(size=(3, 400)) * 2 + rng.normal(size=(60, 400)) * rng.uniform(0.1, 5, 400) + 50
    x[:, 7] = 3.0
    b = signal @ rng.normal(size=(3, 4)) + rng.normal(size=(60, 4))
    c = rng.normal(size=(60, 2)) + 5
    x += c @ rng.normal(size=(2, 400))
    data = [(f"s{k:03d}", k % 2, [-1, 0, 1, 2][(k // 2) % 4], c[k].tolist(), x[k].tolist(), b[k].tolist()) for k in range(60)]
    return spark.createDataFrame(data, "subject_id string, y int, fold int, c array<double>, x array<double>, b array<double>").repartition(5).persist()


def test_grid_equals_numpy_refits_and_block_pca(spark, rows):
    grid = reports.config_grid(spark, ["cca"], [2, 8], [])
    blocks = blocks_of(rows)
    got = values(wide.dual_grid(blocks, rows.select("subject_id", "fold", "c", "b"), grid))
    for dim in (2, 8):
        assert np.allclose(got[f"cca_pca{dim}"], cv(rows.toPandas(), dim), atol=1e-8)
    passes = values(estimators.whole_grid_wide(spark, SF))
    assert all(np.allclose(got[k], passes[k], atol=1e-5) for k in passes)


def test_more_features_than_subjects(spark, wide_rows, monkeypatch):
    """Several lots of training sets, tiles that do not divide the subjects, groups as keys."""
    monkeypatch.setattr(dual, "TASK_CELLS", 5000)
    monkeypatch.setattr(dual, "TILE", 16)
    grid = reports.config_grid(spark, ["cca"], [3], [])
    grouped = split_by_label(wide_rows).select("subject_id", "fold", "c", "b", "grp")
    got = {r["grp"]: r for r in wide.dual_grid(blocks_of(wide_rows, 50), grouped, grid, ["grp"]).collect()}
    pdf = split_by_label(wide_rows).toPandas()
    pdf["x"] = [np.delete(v, 7) for v in pdf["x"]]  # NumPy's refit has no guard for the constant feature
    for name in ("case", "control"):
        want = cv(pdf[pdf.grp == name], 3)
        assert np.allclose([got[name][c] for c in estimators._GRID_COLS], want, atol=1e-7)


def test_eigenvalues_and_scores_equal_block_pca(spark, wide_rows):
    subjects = dual.read_subjects(wide_rows, columns=["fold"])
    fold = subjects.columns["fold"]
    subset = dual.Subset(0, np.flatnonzero(fold >= 0), np.flatnonzero(fold < 0))
    layout = dual.dual_layout(blocks_of(wide_rows, 50), subjects)

    def use(s, pca):
        import pyarrow as pa

        return pa.table({"scores": pa.array([pca.scores.ravel().tolist()]), "values": pa.array([pca.eigenvalues.tolist()]), "total": pa.array([pca.total_variance])})

    got = dual.solve_subsets(layout, subjects, [subset], use, "scores array<double>, values array<double>, total double", 5).first()
    covariates = wide_rows.select("subject_id", F.col("c").alias("covariates"), "fold")
    model, scores = bp.block_pca(blocks_of(wide_rows, 50), 5, covariates, F.col("fold") >= 0, oversample=40)
    assert np.allclose(got["values"], model.eigenvalues, rtol=1e-6) and np.isclose(got["total"], model.total_variance, rtol=1e-9)
    other = {r["subject_id"]: np.abs(r["pcs"]) for r in scores.collect()}
    mine = dict(zip(subjects.ids[subset.rows], np.abs(np.array(got["scores"]).reshape(-1, 5))))
    assert len(mine) == 60 and all(np.allclose(mine[s], other[s], rtol=1e-4, atol=1e-3) for s in mine)


def refit_null(pdf, perm, dim, seed, scales):
    """NumPy's holdout correlations of both groups under permuted labels."""
    ids = sorted(pdf.subject_id)
    own = pdf.set_index("subject_id").loc[ids].reset_index()
    order = dual.md5_order(ids, seed, perm)
    n_case = int((own.y == 1).sum())
    out = {}
    for g, part in ((1, order[:n_case]), (0, order[n_case:])):
        hold = int(np.ceil(0.2 * len(part)))
        t, e = own.iloc[part[hold:]], own.iloc[part[:hold]]
        if scales == "train":
            out[g] = first_pair(arrays(t), arrays(e), dim)[1]
            continue
        (c, x, _), everyone = arrays(own), np.column_stack([np.ones(len(own)), np.vstack(own.c)])
        sd = (x - everyone @ np.linalg.lstsq(everyone, x, rcond=None)[0]).std(axis=0)
        (_, _), (yt, ye) = prepared(arrays(t), arrays(e))
        design = [np.column_stack([np.ones(len(p)), np.vstack(p.c)]) for p in (t, e)]
        beta = np.linalg.lstsq(design[0], np.vstack(t.x) / sd, rcond=None)[0]
        xt, xe = np.vstack(t.x) / sd - design[0] @ beta, np.vstack(e.x) / sd - design[1] @ beta
        main = np.linalg.svd(xt, full_matrices=False)[2][:dim].T
        xt, xe = xt @ main, xe @ main
        (qx, rx), (qy, ry) = np.linalg.qr(xt), np.linalg.qr(yt)
        u, _, v = np.linalg.svd(qx.T @ qy)
        out[g] = np.corrcoef(xe @ np.linalg.solve(rx, u[:, 0]), ye @ np.linalg.solve(ry, v[0]))[0, 1]
    return out[1], out[0]


@pytest.mark.parametrize("scales", ["all", "train"])
def test_label_null_equals_numpy_refits(spark, wide_rows, scales):
    pdf = wide_rows.toPandas()
    pdf["x"] = [np.delete(v, 7) for v in pdf["x"]]
    blocks, side = blocks_of(wide_rows, 50), wide_rows.select("subject_id", "c", "b", "y")
    done = wide.wide_label_null(blocks, side, 3, "cca", 3, scales=scales)
    null = wide.wide_label_null(blocks, side, 6, "cca", 3, scales=scales, completed=done).collect()
    assert sorted(r["perm_id"] for r in null) == list(range(6))
    for r in null:
        want = refit_null(pdf, r["perm_id"], 3, 42, scales)
        assert np.allclose([r["r_case"], r["r_control"], r["diff"]], [*want, want[0] - want[1]], atol=1e-7)


def test_small_groups_have_no_correlation(spark, wide_rows):
    few = wide_rows.where("y = 0 or subject_id < 's010'").select("subject_id", "c", "b", "y")
    null = wide.wide_label_null(blocks_of(wide_rows, 50), few, 2, "cca", 2).collect()
    assert [r["r_case"] for r in null] == [0.0, 0.0] and all(r["r_control"] != 0 for r in null)


def test_export_maps_back_to_single_features(spark, wide_rows):
    got = wide.wide_export(blocks_of(wide_rows, 50), wide_rows.select("subject_id", "fold", "c", "b"), "cca", 3, k=2)
    pdf = wide_rows.toPandas()
    t, e = arrays(pdf[pdf.fold >= 0]), arrays(pdf[pdf.fold < 0])
    keep = np.arange(400) != 7
    (xt, xe), (yt, ye) = prepared((t[0], t[1][:, keep], t[2]), (e[0], e[1][:, keep], e[2]))
    main = np.linalg.svd(xt, full_matrices=False)[2][:3].T
    (qx, rx), (qy, _) = np.linalg.qr(xt @ main), np.linalg.qr(yt)
    u, r, _ = np.linalg.svd(qx.T @ qy)
    weights = main @ np.linalg.solve(rx, u[:, :2]) * np.sqrt(len(xt))
    table = got["x_weights"].toPandas()
    assert len(table) == 400 * 2 and set(table.gene) == {f"g{i}" for i in range(8)}
    table["at"] = table.gene.str[1:].astype(int) * 50 + table.dim
    for component in (0, 1):
        own = table[table.component == component].sort_values("at")
        assert own.weight.iloc[7] == 0 and own.loading.iloc[7] == 0
        w = own.weight.to_numpy()[keep]
        sign = np.sign(w @ weights[:, component])
        assert np.allclose(w * sign, weights[:, component], atol=1e-8)
        variate = xt @ weights[:, component]
        want = [np.corrcoef(xt[:, j], variate)[0, 1] for j in range(xt.shape[1])]
        assert np.allclose(own.loading.to_numpy()[keep] * sign, want, atol=1e-8)
    assert np.allclose([x["r_train"] for x in got["correlations"].orderBy("component").collect()], r[:2], atol=1e-9)
    by_gene = {x["gene"]: x["l2"] for x in got["genes"].where("component = 0").collect()}
    padded = np.zeros(400)
    padded[keep] = weights[:, 0]
    assert np.allclose([by_gene[f"g{i}"] for i in range(8)], np.sqrt((padded.reshape(8, 50) ** 2).sum(axis=1)), atol=1e-8)
    sides = got["variates"].toPandas()
    assert len(sides) == 60 and np.isclose(abs(np.corrcoef([x[0] for x in sides[sides.fold >= 0].u], [x[0] for x in sides[sides.fold >= 0].v])[0, 1]), r[0])
    assert wide.top_features(got, 5).groupBy("component").count().collect()[0]["count"] == 5


def test_stratified_comparison(spark, rows):
    """Both groups' best configurations and holdout correlations as without blocks; cosines on single features."""
    grouped = coupling.assign_splits(split_by_label(estimators.pairs(spark, SF)), group="grp")
    grid = reports.config_grid(spark, ["cca"], [2, 8], [])
    got = wide.wide_stratified(blocks_of(grouped), grouped.select("subject_id", "fold", "c", "b", "grp"), grid).first()
    want = estimators.whole_stratified(spark, SF).first()
    assert (got["case_config"], got["control_config"]) == (want["case_config"], want["control_config"])
    for c in ("r_case", "r_control", "r_diff"):
        assert np.isclose(got[c], want[c], atol=1e-8)
    for c in ("x_weight_cosine", "y_weight_cosine"):  # components have no sign of their own
        assert np.isclose(abs(got[c]), abs(want[c]), atol=1e-6)


def test_broken_input_is_an_error(spark, wide_rows, monkeypatch):
    side = wide_rows.select("subject_id", "fold", "c", "b")
    grid = reports.config_grid(spark, ["cca"], [2], [])
    short = blocks_of(wide_rows, 50).where("not (gene = 'g3' and subject_id = 's010')")
    with pytest.raises(Exception, match="every subject needs every block once: block 'g3'"):
        wide.dual_grid(short, side, grid).collect()
    with pytest.raises(ValueError, match="once, with an id"):
        wide.dual_grid(short, side.unionByName(side.limit(1)), grid)
    monkeypatch.setattr(dual, "MAX_SUBJECTS", 50)
    with pytest.raises(ValueError, match="more than 50 subjects"):
        wide.dual_grid(short, side, grid)
