"""Many small array files: decoded together, contents read and made once."""

import io

import numpy as np
import pandas as pd
from conftest import SF
from pyspark.sql import types as T

from pairlens.catalog import inputs
from pairlens.sources import arrays


class Files:
    """Stands for the files' table: gives the function that tasks run."""

    schema = T.StructType([T.StructField("subject_id", T.StringType()), T.StructField("content", T.BinaryType())])

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):  # noqa: N802
        return run


def packed(mat):
    out = io.BytesIO()
    np.save(out, mat)
    return out.getvalue()


def test_small_files_leave_in_common_batches(monkeypatch):
    mats = [np.arange(12.0).reshape((6, 2) if k % 2 else (2, 6)) + k for k in range(300)]
    pdf = pd.DataFrame({"subject_id": [str(k) for k in range(300)], "content": [packed(m) for m in mats]})
    fields = [T.StructField("t", T.IntegerType()), T.StructField("roi", T.IntegerType()), T.StructField("value", T.DoubleType())]
    run = arrays._decode(Files(), ["subject_id"], arrays._series_rows, fields)
    frames = list(run([pdf[:100], pdf[100:]]))
    assert len(frames) == 1 and len(frames[0]) == 3600
    for k in (0, 1, 299):
        own = frames[0][frames[0].subject_id == str(k)]
        long = mats[k] if k % 2 else mats[k].T
        assert np.array_equal(own.value.to_numpy().reshape(6, 2), long) and own.t.tolist() == np.repeat(range(6), 2).tolist() and own.roi.tolist() == [0, 1] * 6
    vectors = list(arrays._decode(Files(), ["subject_id"], arrays._oriented_rows, [T.StructField("t", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))])([pdf]))
    assert len(vectors) == 1 and np.array_equal(np.vstack(vectors[0]["values"]), np.vstack([m if k % 2 else m.T for k, m in enumerate(mats)]))
    monkeypatch.setattr(arrays, "BATCH_CELLS", 120)
    assert [len(f) for f in run([pdf])] == [120] * 30
    assert list(run([pdf[:0]])) == []


def test_series_files_are_made_once(spark):
    got = inputs.read_roi_timeseries(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "ReadSchema: struct<path:string>" in plan
    files = inputs.series_files(spark, SF, "/roi/sub{sid}/series.npy")
    assert files.count() == 2 * files.selectExpr("regexp_extract(path, 'sub([0-9]+)', 1) as s").distinct().count()
