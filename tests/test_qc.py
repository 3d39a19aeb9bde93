"""Atlas overlap: subjects by the million share the few voxels of a mask."""

from pyspark.sql import functions as F

from pairlens.operators import qc


def test_overlap_never_deals_rows_by_voxel(spark):
    """Without a broadcast by size, rows used to be dealt by voxel: a task per voxel of the mask, each with a row of every subject."""
    voxels = spark.range(4000).select(F.floor(F.col("id") / 4).cast("string").alias("subject_id"), (F.col("id") % 4).cast("int").alias("voxel"), (F.col("id") % 3).cast("double").alias("value"))
    atlas = spark.createDataFrame([(1,), (2,), (2,), (None,), (9,)], "voxel int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = qc.atlas_overlap(voxels.unionByName(spark.createDataFrame([("x", None, 1.0)], voxels.schema)), atlas)
        rows = {r["subject_id"]: (r["n_voxels"], r["overlap"]) for r in got.collect()}
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(rows) == 1000 and all(rows[str(s)] == (2, sum((4 * s + v) % 3 != 0 for v in (1, 2)) / 2) for s in range(1000))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
