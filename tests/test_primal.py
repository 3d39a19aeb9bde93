"""The features' side of wide views against the dual, on subjects that the dual still takes."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_dual import blocks_of

from pairlens.catalog import estimators
from pairlens.operators import dual, primal, reports
from pairlens.operators.splits import split_by_label
from pairlens.plans import coupling, wide


@pytest.fixture(scope="module")
def rows(spark):
    """120 subjects, 32 features, one of them constant; 8 values of the second view, so that no training set of a group can be fitted perfectly."""
    got = split_by_label(coupling.assign_splits(estimators.pairs(spark, SF)))
    x = F.transform("x", lambda v, i: F.when(i == 5, 2.0).otherwise(v))
    return got.select("subject_id", "y", "fold", "grp", "c", x.alias("x"), F.slice("b", 1, 8).alias("b")).persist()


@pytest.fixture
def both(monkeypatch):
    """A call's result by the dual, and with more subjects than that takes."""

    def run(call):
        want = call()
        with monkeypatch.context() as m:
            m.setattr(dual, "MAX_SUBJECTS", 50)
            m.setattr(primal, "DUAL_SUBJECTS", 50)
            m.setattr(primal, "LOT_CELLS", 40_000)
            return want, call()

    return run


def close(want, got, keys, tol=1e-7):
    want, got = (t.sort_values(keys).reset_index(drop=True) for t in (want, got))
    assert list(want.columns) == list(got.columns) and len(want) == len(got)
    for c in want.columns:
        if want[c].dtype.kind == "f":
            assert np.allclose(want[c], got[c], atol=tol, equal_nan=True), c
        elif c in keys:
            assert (want[c] == got[c]).all(), c


@pytest.mark.parametrize("scales", ["train", "all"])
def test_grid_by_group(spark, rows, both, scales):
    grid = reports.config_grid(spark, ["cca", "scca"], [2, 6], [0.5])
    want, got = both(lambda: wide.dual_grid(blocks_of(rows), rows.select("subject_id", "fold", "c", "b", "grp"), grid, ["grp"], scales=scales).toPandas())
    assert got.error.isna().all() and len(got) == 8
    close(want, got, ["grp", "position"])


@pytest.mark.parametrize("scales", ["train", "all"])
def test_label_null(spark, rows, both, scales):
    done = spark.createDataFrame([(1, 0.5, 0.25, 0.25)], "perm_id int, r_case double, r_control double, diff double")
    want, got = both(lambda: wide.wide_label_null(blocks_of(rows), rows.select("subject_id", "c", "b", "y"), 5, "cca", 3, scales=scales, completed=done).toPandas())
    assert sorted(got.perm_id) == list(range(5))
    close(want, got, ["perm_id"])


@pytest.mark.parametrize("few", [0, 8])
def test_label_null_of_small_groups(spark, rows, both, few):
    cases = rows.where("y = 1").orderBy("subject_id").limit(few)
    own = rows.where("y = 0").unionByName(cases).select("subject_id", "c", "b", "y")
    want, got = both(lambda: wide.wide_label_null(blocks_of(rows), own, 2, "cca", 2).toPandas())
    assert (got.r_case == 0).all() and (got.r_control != 0).all()
    close(want, got, ["perm_id"])


def test_hash_cuts_are_places_of_the_order(spark, rows):
    ids = sorted(r[0] for r in rows.select("subject_id").collect())
    cuts = primal.hash_cuts(rows, 20_000, [0, 3], [1, 17, len(ids)], 7)
    for perm in (0, 3):
        order = dual.md5_order(ids, 7, perm)
        assert [cuts[perm, place][1] for place in (1, 17, len(ids))] == [ids[order[place - 1]] for place in (1, 17, len(ids))]


def test_export(spark, rows, both):
    want, got = both(lambda: {k: t.toPandas() for k, t in wide.wide_export(blocks_of(rows), rows.select("subject_id", "fold", "c", "b"), "cca", 6, k=2, inflate=True).items()})
    for name, keys in (("x_weights", ["gene", "dim", "component"]), ("y_weights", ["position", "component"]), ("y_loadings", ["position", "component"]), ("genes", ["gene", "component"]), ("correlations", ["component"])):
        for table in (want[name], got[name]):  # components have no sign of their own
            for c in set(table.columns) & {"weight", "loading"}:
                table[c] = table[c].abs()
        close(want[name], got[name], keys)
    sides = [t["variates"].sort_values("subject_id").reset_index(drop=True) for t in (want, got)]
    assert (sides[0].subject_id == sides[1].subject_id).all() and (sides[0].fold == sides[1].fold).all()
    for c in "uv":
        assert np.allclose(*[np.abs(np.vstack(s[c])) for s in sides], atol=1e-7)


@pytest.mark.parametrize("scope", ["fold", "train"])
def test_scores(spark, rows, both, scope):
    side = rows.select("subject_id", "fold", "y", "c", "b")
    want, got = both(lambda: wide.wide_scores(blocks_of(rows), side, 4, ["gene_only", "cca_joint"], k=2, scope=scope).toPandas())
    assert len(got) == 2 * 120
    close(want, got, ["model", "subject_id"], 1e-5)


def test_sparse_weights(spark, rows, both):
    side = rows.select("subject_id", "fold", "c", "b")
    want, got = both(lambda: {k: t.toPandas() for k, t in wide.wide_sparse(blocks_of(rows), side, 1, 0.3, 0.5, cv=False, projection="paper", max_iter=60, tol=1e-8).items()})
    close(want["folds"], got["folds"], ["fold", "component"], 1e-5)
    close(want["x_weights"], got["x_weights"], ["gene", "dim", "component"], 1e-4)
    close(want["y_weights"], got["y_weights"], ["position", "component"], 1e-4)


def test_sparse_folds(spark, rows, monkeypatch):
    monkeypatch.setattr(dual, "MAX_SUBJECTS", 50)
    monkeypatch.setattr(primal, "DUAL_SUBJECTS", 50)
    side = rows.where("fold >= 0").select("subject_id", "fold", "c", "b")  # no holdout: the final fit takes all, and scores none
    got = wide.wide_sparse(blocks_of(rows), side, 2, 0.5, 0.5, max_iter=20)["folds"].toPandas()
    assert sorted(got.fold) == sorted(2 * [-1, *range(5)])
    assert (got[got.fold == -1].r_val == 0).all() and (got.r_train.abs() > 0.1).all() and (got[got.fold >= 0].r_val != 0).all()


def test_broken_input_is_an_error(spark, rows, monkeypatch):
    monkeypatch.setattr(primal, "DUAL_SUBJECTS", 50)
    side = rows.select("subject_id", "fold", "c", "b")
    grid = reports.config_grid(spark, ["cca"], [2], [])
    one = rows.first()["subject_id"]
    with pytest.raises(Exception, match="every subject needs every block once"):
        wide.dual_grid(blocks_of(rows).where(f"not (gene = 'g3' and subject_id = '{one}')"), side, grid).collect()
    with pytest.raises(Exception, match="every subject needs every block once"):
        wide.dual_grid(blocks_of(rows).where(f"subject_id <> '{one}'"), side, grid).collect()
    with pytest.raises(ValueError, match="once, with an id"):
        wide.dual_grid(blocks_of(rows), side.unionByName(side.limit(1)), grid)
    # More features than subjects stay with the dual.
    wider = rows.withColumn("x", F.flatten(F.array(*[F.col("x")] * 4)))
    assert primal.primal(blocks_of(wider), wider, ["fold"]) is None
