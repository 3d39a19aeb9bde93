"""Files on disk."""

import json

import numpy as np
import pytest

from pairlens.operators import align, features, splits
from pairlens.sources import arrays, results, tables
from pairlens.functions import parse_config


def test_chunks_in_numeric_order(spark, tmp_path):
    for gene in ("A", "B"):
        d = tmp_path / gene
        d.mkdir()
        for k in range(12):
            np.save(d / f"embeddings_{k}_layer_last.npy", np.full((2, 3), k, dtype=np.float32))
        np.save(d / "other.npy", np.zeros((1, 3)))
    (tmp_path / "B" / "embeddings_3_layer_last.npy").unlink()
    rows = arrays.read_embedding_chunks(spark, str(tmp_path), n_files=12, skip_incomplete=True).toPandas()
    assert set(rows["gene"]) == {"A"} and len(rows) == 24
    rows = rows.sort_values("row_idx")
    assert [int(e[0]) for e in rows["embedding"]] == [k for k in range(12) for _ in range(2)]
    with pytest.raises(ValueError, match="missing chunks"):
        arrays.read_embedding_chunks(spark, str(tmp_path), n_files=12)


def test_time_series_orientation_first_file_and_ids(spark, tmp_path):
    for sid, shape in (("11", (9, 3)), ("12", (3, 9))):
        d = tmp_path / f"sub{sid}"
        d.mkdir()
        np.save(d / "a.npy", np.arange(27, dtype=float).reshape(shape))
        np.save(d / "b.npy", np.zeros(shape))
    ts = arrays.read_roi_timeseries(spark, str(tmp_path)).toPandas()
    assert set(ts["subject_id"]) == {"11", "12"} and ts["roi"].max() == 2 and ts["t"].max() == 8
    assert ts["value"].sum() == 2 * np.arange(27).sum()
    only = arrays.read_roi_timeseries(spark, str(tmp_path), ids=spark.createDataFrame([("12",)], "subject_id string"))
    assert {r.subject_id for r in only.collect()} == {"12"}
    assert arrays.read_roi_timeseries(spark, str(tmp_path), limit=1).select("subject_id").distinct().count() == 1


def test_results_skip_broken_and_unfinished(spark, tmp_path):
    (tmp_path / "m_a_results.json").write_text(json.dumps({"status": "FINISHED", "r": 0.5}, indent=2))
    (tmp_path / "m_b_results.json").write_text(json.dumps({"status": "RUNNING", "r": 0.1}))
    (tmp_path / "m_c_results.json").write_text("{ broken")
    got = results.read_results(spark, f"{tmp_path}/*_results.json", "status string, r double").collect()
    assert [(r.source, r.r) for r in got] == [("m_a_results.json", 0.5)]


def test_csv_keeps_first_row_and_nan(spark, tmp_path):
    (tmp_path / "f.csv").write_text("participant.eid,p1,p2\n7,1.5,\n7,9,9\n8,2,3\n9,1,1\n")
    ids = spark.createDataFrame([("7",), ("8",)], "subject_id string")
    got = {r.subject_id: r for r in tables.read_tabular_features(spark, str(tmp_path / "f.csv"), ids=ids).collect()}
    assert set(got) == {"7", "8"} and got["7"].p1 == 1.5 and np.isnan(got["7"].p2)
    with pytest.raises(ValueError, match="no id column"):
        tables.read_tabular_features(spark, str(tmp_path / "f.csv"), id_col="eid")


def test_name_lists(spark, tmp_path):
    (tmp_path / "n.txt").write_text("  a \n\n b\nc\n")
    assert [r.name for r in tables.read_name_list(spark, str(tmp_path / "n.txt")).orderBy("position").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="expected 4"):
        tables.read_feature_names(spark, 4, "gene", str(tmp_path / "n.txt"))
    (tmp_path / "d.csv").write_text("Column,Description\nx,y\n")
    with pytest.raises(ValueError, match="Column Name"):
        tables.read_field_dictionary(spark, str(tmp_path / "d.csv"))


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("1", [1.0, 2.0], [3.0], 1), ("2", [2.0, 2.0], [3.0], 0)], "subject_id string, x array<double>, y_features array<double>, y int")
    meta = results.write_aligned_dataset(df, str(tmp_path / "d"), str(tmp_path / "m")).first()
    assert (meta.n_subjects, meta.n_case, meta.x_dim, meta.y_dim) == (2, 1, 2, 1)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    a = results.dataset_fingerprint(df.select("subject_id", "y"), ["subject_id", "y"]).first()
    b = results.dataset_fingerprint(df.select("subject_id", "y").orderBy("y"), ["subject_id", "y"]).first()
    assert a == b


def test_error_paths(spark):
    ids = spark.createDataFrame([("1", 0), ("2", 1)], "subject_id string, pos int")
    data = spark.createDataFrame([("1", 5)], "subject_id string, v int")
    with pytest.raises(Exception, match="requested id is absent: 2"):
        align.take_in_order(ids, data).collect()
    with pytest.raises(ValueError, match="no aligned rows"):
        align.require_rows(align.align_two(ids, data.filter("v > 9")))
    with pytest.raises(ValueError, match="keep must be"):
        align.align_two(ids, ids, position="pos", keep="middle")
    with pytest.raises(Exception, match="exactly two values"):
        splits.binarize_label(spark.createDataFrame([(1,), (2,), (3,)], "y int")).collect()
    with pytest.raises(Exception, match="unparseable configuration"):
        spark.createDataFrame([("scca_pca64_c0.1",)], "c string").select(parse_config("c")).collect()
    blocks = spark.createDataFrame([("1", "g0", [1.0])], "subject_id string, gene string, embedding array<double>")
    with pytest.raises(Exception, match="lacks a gene block"):
        features.widen_genes(blocks, ["g0", "g1"]).collect()
