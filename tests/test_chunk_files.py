"""The array-file source: pruned reads, shown by files whose unread parts are missing."""

import os

import numpy as np
import pytest

from pairlens.sources import arrays, chunk_files


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    whole = {}
    for gene, counts in (("g0", (5, 7, 4, 6, 3, 8, 5, 5, 5, 5, 9)), ("g1", (10, 53))):
        os.makedirs(tmp_path / gene)
        parts = [rng.normal(size=(n, 6)).astype(np.float32 if gene == "g0" else np.float64) for n in counts]
        for k, part in enumerate(parts):
            np.save(tmp_path / gene / f"embeddings_{k}_layer_last.npy", part)
        np.save(tmp_path / gene / "notes.npy", np.zeros(3))
        whole[gene] = np.vstack(parts)
    (tmp_path / "readme.txt").write_text("not a gene")
    return tmp_path, whole


def test_all_rows_as_the_other_reader_gives_them(spark, folder):
    path, whole = folder
    got = chunk_files.read_array_files(spark, str(path), chunks=3).orderBy("gene", "row_idx").collect()
    want = arrays.read_embedding_chunks(spark, f"file://{path}").orderBy("gene", "row_idx").collect()
    assert [(r["gene"], r["chunk"], r["row_in_chunk"], r["row_idx"], r["embedding"]) for r in got] == [(r["gene"], r["chunk"], r["row_in_chunk"], r["row_idx"], r["embedding"]) for r in want]
    assert np.allclose([r["embedding"] for r in got], np.vstack([whole["g0"], whole["g1"]]), atol=1e-7)


def test_only_wanted_chunks_are_read(spark, folder):
    """Chunks without a wanted row keep nothing but their header, and the rest of a wanted chunk ends after its last wanted row."""
    path, whole = folder
    rows = [0, 2, 3, 13, 60, 61]
    report = chunk_files.read_array_files(spark, f"file://{path}", rows, report=True).toPandas()
    assert report.groupby("gene").n_rows.sum().to_dict() == {"g0": 62, "g1": 63}
    needed = report[report.rows_read > 0]
    assert sorted(zip(needed.gene, needed.chunk, needed.rows_read)) == [("g0", 0, 3), ("g0", 2, 1), ("g0", 10, 2), ("g1", 0, 3), ("g1", 1, 3)]
    assert (report.bytes_read == report.rows_read * 6 * np.where(report.gene == "g0", 4, 8)).all()
    for r in report.itertuples():
        file = path / r.gene / f"embeddings_{r.chunk}_layer_last.npy"
        (_, width), dtype, offset = chunk_files.read_header(str(file))
        last = max((x - r.first_row + 1 for x in rows if r.first_row <= x < r.first_row + r.n_rows), default=0)
        os.truncate(file, offset + int(last) * width * dtype.itemsize)
    got = chunk_files.read_array_files(spark, str(path), rows).orderBy("gene", "row_idx").collect()
    assert np.allclose([r["embedding"] for r in got], np.vstack([whole["g0"][rows], whole["g1"][rows]]), atol=1e-7)
    with pytest.raises(Exception, match="ends before row"):
        chunk_files.read_array_files(spark, str(path), [14]).collect()


def test_cohort_in_its_order(spark, folder):
    path, whole = folder
    ids = spark.createDataFrame([(f"s{k}", k) for k in range(62)], "subject_id string, row_idx bigint")
    wanted = spark.createDataFrame([("s40", 0), ("s3", 1), ("s61", 2)], "subject_id string, pos int")
    got = chunk_files.take_rows(spark, str(path), ids, wanted, genes=["g0"]).orderBy("pos").collect()
    assert [r["subject_id"] for r in got] == ["s40", "s3", "s61"]
    assert np.allclose([r["embedding"] for r in got], whole["g0"][[40, 3, 61]])
    with pytest.raises(Exception, match="requested id is absent"):
        chunk_files.take_rows(spark, str(path), ids, wanted.unionByName(spark.createDataFrame([("none", 3)], wanted.schema))).collect()


def test_odd_folders(spark, tmp_path, folder):
    empty = tmp_path / "nothing"
    os.makedirs(empty)
    assert chunk_files.read_array_files(spark, str(empty)).count() == 0
    path, _ = folder
    assert chunk_files.read_array_files(spark, str(path), []).count() == 0
    np.save(path / "g1" / "embeddings_2_layer_last.npy", np.zeros(4))
    with pytest.raises(Exception, match="2-D chunk"):
        chunk_files.read_array_files(spark, str(path)).collect()
