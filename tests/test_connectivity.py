"""Edges against NumPy, whatever way the rows are spread."""

import numpy as np
import pandas as pd
import pytest

from pairlens.operators import connectivity as cn
from pairlens.operators import moments as mo

RNG = np.random.default_rng(2)


def series(subjects=4, t=60, r=6):
    rows = []
    data = {}
    for s in range(subjects):
        m = RNG.standard_normal((t, r)) @ RNG.standard_normal((r, r)) + 100
        data[str(s)] = m
        ti, ri = np.indices(m.shape)
        rows.append(pd.DataFrame({"subject_id": str(s), "t": ti.ravel(), "roi": ri.ravel(), "value": m.ravel()}))
    return data, pd.concat(rows).sample(frac=1, random_state=0)


def test_edges_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(cn, "TIME_BLOCK", 16)  # one subject over several tasks
    data, pdf = series()
    got = cn.fc_edges(spark.createDataFrame(pdf)).toPandas()
    for s, m in data.items():
        r = np.corrcoef(m.T)
        part = got[got["subject_id"] == s]
        assert len(part) == 15
        want = np.arctanh(np.clip(r[part["roi_i"], part["roi_j"]], -0.999999, 0.999999))
        assert np.allclose(part["z"], want, atol=1e-7)


def test_partial_sums_may_be_flushed(spark, monkeypatch):
    data, pdf = series()
    want = cn.fc_edges(spark.createDataFrame(pdf)).toPandas().sort_values(["subject_id", "roi_i", "roi_j"])
    monkeypatch.setattr(mo, "FLUSH_CELLS", 1)
    got = cn.fc_edges(spark.createDataFrame(pdf)).toPandas().sort_values(["subject_id", "roi_i", "roi_j"])
    assert np.allclose(got["z"], want["z"], atol=1e-9)


def test_perfect_correlation_is_clipped_and_constants_follow_the_rule(spark):
    t = np.arange(20)
    mat = np.stack([t, 2 * t + 1, np.full(20, 3.0)], axis=1).astype(float)
    ti, ri = np.indices(mat.shape)
    df = spark.createDataFrame(pd.DataFrame({"subject_id": "s", "t": ti.ravel(), "roi": ri.ravel(), "value": mat.ravel()}))
    got = {(r.roi_i, r.roi_j): r.z for r in cn.fc_edges(df).collect()}
    assert abs(got[(0, 1)] - 7.254329) < 1e-6 and got[(0, 2)] is None
    assert {r.z for r in cn.fc_edges(df, nan="zero").collect() if r.roi_j == 2} == {0.0}
    assert cn.fc_edges(df, nan="drop").count() == 0
    assert {r.z for r in cn.fc_edges(df, denominator="n-1").collect() if r.roi_j == 2} == {0.0}


def test_strict_form_names_the_absent_subject(spark):
    _, pdf = series(2)
    wanted = spark.createDataFrame([("0",), ("9",)], "subject_id string")
    with pytest.raises(Exception, match="no usable time series for 9"):
        cn.fc_edges(spark.createDataFrame(pdf), required=wanted).collect()


def test_network_edges_equal_averaged_zscores(spark):
    data, pdf = series()
    nets = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "B"), (4, "B"), (5, "C")], "roi int, network string")
    cov = cn.roi_covariance(cn.timeseries_vectors(spark.createDataFrame(pdf)))
    got = cn.network_fc(cov, nets).toPandas()
    for s, m in data.items():
        z = (m - m.mean(0)) / m.std(0)
        g = {"A": z[:, :2].mean(1), "B": z[:, 2:5].mean(1), "C": z[:, 5]}
        for row in got[got["subject_id"] == s].itertuples():
            assert abs(row.z - np.arctanh(np.corrcoef(g[row.group_i], g[row.group_j])[0, 1])) < 1e-7


def test_unmapped_network_and_empty_selection_are_errors(spark):
    df = spark.createDataFrame([(0, "Nowhere")], "roi int, network17 string")
    with pytest.raises(Exception, match="unmapped network"):
        cn.map_networks(df).collect()
    with pytest.raises(ValueError):
        cn.select_networks(df.withColumnRenamed("network17", "roi_name"), ["Vis"])


def test_no_pair_join_in_the_plan(spark):
    _, pdf = series(2)
    plan = cn.fc_edges(spark.createDataFrame(pdf))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_incomplete_time_point_is_an_error_or_leaves_the_subject_out(spark):
    _, pdf = series(2)
    holed = spark.createDataFrame(pdf[~((pdf["subject_id"] == "1") & (pdf["t"] == 3) & (pdf["roi"] == 2))])
    with pytest.raises(Exception, match="lacks a region"):
        cn.fc_edges(holed).collect()
    short = spark.createDataFrame(pdf[~((pdf["subject_id"] == "1") & (pdf["roi"] == 5))])
    assert {r.subject_id for r in cn.fc_edges(short, n_rois=6).collect()} == {"0"}
