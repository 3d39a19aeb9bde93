"""Sources and sinks on the given tables.

Array files are made by Spark as (path, content) rows and go through the same decoding
as files on disk; text formats are written to a scratch path and read back.
"""

from __future__ import annotations

import io
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.catalog.fixtures import r6, round_columns, sql
from pairlens.catalog.registry import register
from pairlens.session import scratch_path, written
from pairlens.functions import config_label
from pairlens.operators import align, reports
from pairlens.plans import coupling
from pairlens.sources import arrays, chunk_files, results, tables


def _npy(mat: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, mat)
    return out.getvalue()


def _embedding_files(spark, sf):
    """One array file per gene and chunk of 50 vectors, plus a stray file the pattern must skip."""

    def pack(pdf):
        pdf = pdf.sort_values("row_in_chunk")
        gene, chunk = pdf["gene"].iloc[0], pdf["chunk"].iloc[0]
        content = _npy(np.stack(pdf["embedding"].to_list()).astype(np.float32))
        names = [f"embeddings_{chunk}_layer_last.npy"] + (["notes.npy"] if chunk == 0 else [])
        return pd.DataFrame({"path": [f"/data/{gene}/{n}" for n in names], "content": [content] * len(names)})

    return fx.blocks(spark, sf).groupBy("gene", "chunk").applyInPandas(pack, "path string, content binary")


_CHUNK_SQL = sql(
    "block_values",
    f"SELECT gene, CAST(v.subject_id AS BIGINT) AS row_idx, {r6('sum(v)')} AS total, {r6('max(v)')} AS top FROM block_values AS v GROUP BY 1, 2",
)


def _chunk_summary(rows):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    out = rows.select("gene", "row_idx", total.alias("total"), F.array_max("embedding").cast("double").alias("top"))
    return round_columns(out, "total", "top")


@register("read_embedding_chunks", _CHUNK_SQL)
def read_embedding_chunks(spark, sf):
    return _chunk_summary(arrays.embedding_rows(_embedding_files(spark, sf)))


def _embedding_folder(spark, sf) -> str:
    """The array files on disk, written by tasks into the shared folder; a name without the number's pattern is skipped by readers."""
    path = scratch_path(spark, "array-files")

    def write(batches):
        root = path.removeprefix("file://")
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                target = root + name.removeprefix("/data")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.{uuid.uuid4().hex}", "wb") as file:
                    file.write(content)
                os.replace(file.name, target)  # a task that runs again leaves the same file
            yield pdf[["path"]]

    _embedding_files(spark, sf).mapInPandas(write, "path string").count()
    return path


_TAKEN = "SELECT subject_id, row_number() OVER (ORDER BY subject_id DESC) - 1 AS pos FROM (SELECT DISTINCT subject_id FROM emb JOIN cov USING (subject_id) WHERE valid AND y = 1)"


@register(
    "take_rows_from_files",
    sql(
        "block_values emb cov",
        f"SELECT w.subject_id AS subject_id, w.pos AS pos, gene, {r6('sum(v)')} AS total, {r6('max(v)')} AS top FROM wanted w JOIN block_values b ON w.subject_id = b.subject_id GROUP BY 1, 2, 3",
        wanted=_TAKEN,
    ),
)
def take_rows_from_files(spark, sf):
    """Rows of a cohort in its order, read from the chunks of the array files that hold them."""
    ids = fx.emb(spark, sf).select("subject_id", F.col("subject_id").cast("bigint").alias("row_idx"))
    cohort = align.attach_covariates(fx.emb(spark, sf).where("y = 1"), fx.cov(spark, sf)).select("subject_id").distinct()
    wanted = cohort.withColumn("pos", F.row_number().over(Window.orderBy(F.col("subject_id").desc())).cast("bigint") - 1)  # a cohort, at most MAX_WANTED
    got = chunk_files.take_rows(spark, _embedding_folder(spark, sf), ids, wanted)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return round_columns(got.select("subject_id", "pos", "gene", total.alias("total"), F.array_max("embedding").cast("double").alias("top")), "total", "top")


@register(
    "array_files_report",
    sql(
        "blocks",
        "SELECT gene, chunk, CAST(min(CAST(subject_id AS BIGINT)) AS BIGINT) AS first_row, count(*) AS n_rows, count(*) FILTER (WHERE CAST(subject_id AS BIGINT) % 7 = 0 AND chunk < 3) AS rows_read, "
        "32 * count(*) FILTER (WHERE CAST(subject_id AS BIGINT) % 7 = 0 AND chunk < 3) AS bytes_read FROM blocks WHERE gene IN ('g1', 'g4') GROUP BY 1, 2",
    ),
)
def array_files_report(spark, sf):
    """What the source reads of each chunk: every seventh row of the first three chunks of two genes, 8 values of 4 bytes each."""
    rows = [r[0] for r in fx.blocks(spark, sf).where("chunk < 3 and gene = 'g1'").select(F.col("subject_id").cast("bigint").alias("r")).where("r % 7 = 0").collect()]
    return chunk_files.read_array_files(spark, _embedding_folder(spark, sf), rows, ["g1", "g4"], chunks=2, report=True)


@register(
    "read_embedding_catalog",
    sql("blocks", "SELECT gene, count(DISTINCT chunk) AS n_files, min(chunk) AS first_chunk, max(chunk) AS last_chunk FROM blocks GROUP BY gene"),
)
def read_embedding_catalog(spark, sf):
    catalog = arrays.embedding_catalog(_embedding_files(spark, sf).drop("content"))
    return catalog.groupBy("gene").agg(
        F.countDistinct("chunk").alias("n_files"), F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk")
    )


@register(
    "read_embedding_catalog_skip",
    sql(
        "blocks",
        "SELECT gene, count(*) AS n_rows FROM blocks WHERE gene IN (SELECT gene FROM kept) GROUP BY gene",
        kept="SELECT gene FROM blocks WHERE gene <> 'g3' OR chunk <> 2 GROUP BY gene HAVING count(DISTINCT chunk) = (SELECT count(DISTINCT chunk) FROM blocks)",
    ),
)
def read_embedding_catalog_skip(spark, sf):
    """A gene that lacks a chunk file is left out."""
    files = _embedding_files(spark, sf).filter("path <> '/data/g3/embeddings_2_layer_last.npy'")
    expected = fx.blocks(spark, sf).select("chunk").distinct().count()
    rows = arrays.embedding_rows(files, n_files=expected, skip_incomplete=True)
    return rows.groupBy("gene").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "global_row_index",
    sql("blocks", "SELECT gene, subject_id, CAST(subject_id AS BIGINT) AS row_idx FROM blocks"),
)
def global_row_index(spark, sf):
    return align.global_row_index(fx.blocks(spark, sf), "gene", "chunk", "row_in_chunk").select("gene", "subject_id", "row_idx")


@register(
    "cumulative_offset",
    sql(
        "blocks",
        "SELECT gene, chunk, n, CAST(coalesce(sum(n) OVER (PARTITION BY gene ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_offset FROM s",
        s="SELECT gene, chunk, count(*) AS n FROM blocks GROUP BY 1, 2",
    ),
)
def cumulative_offset(spark, sf):
    sizes = fx.blocks(spark, sf).groupBy("gene", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return align.cumulative_offset(sizes, "gene", "chunk", "n")


@register(
    "check_row_count",
    sql(
        "blocks",
        "SELECT gene, count(*) AS n_rows, (SELECT count(*) FROM embeddings) AS n_ids FROM blocks WHERE gene <> 'g5' OR chunk > 0 "
        "GROUP BY gene HAVING count(*) <> (SELECT count(*) FROM embeddings)",
    ),
)
def check_row_count(spark, sf):
    rows = fx.blocks(spark, sf).filter("gene <> 'g5' or chunk > 0")
    return arrays.check_row_count(rows, fx.emb(spark, sf).select("subject_id"))


def series_files(spark, sf, path):
    """One array file per user, regions by time for even users (to be transposed), as a written table: paths are read without contents, as those of files on disk."""

    def pack(batches):
        for batch in batches:
            values, sizes = batch.column("v"), batch.column("v").value_lengths().to_pylist()
            flat, at, paths, contents = values.flatten().to_numpy(zero_copy_only=False), 0, [], []
            for sid, n, n_t in zip(batch.column("subject_id").to_pylist(), sizes, batch.column("n_t").to_pylist()):
                mat = flat[at : at + n].reshape(n_t, -1)
                at += n
                mat = mat.T if int(sid) % 2 == 0 else mat
                names = [path.format(sid=sid), path.format(sid=sid).replace(".npy", "_zz.npy")] if "sub" in path else [path.format(sid=sid)]
                paths += names
                contents += [_npy(mat)] + [_npy(mat * 0)] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    series = fx.ts(spark, sf).groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("t", "roi", "value"))).alias("s"))
    rows = series.select("subject_id", F.transform("s", lambda r: r["value"]).alias("v"), F.size(F.array_distinct(F.transform("s", lambda r: r["t"]))).alias("n_t"))
    return written(rows.mapInArrow(pack, "path string, content binary"), "series-files")


_SERIES_SQL = sql(
    "ts", f"SELECT subject_id, roi, count(*) AS n_t, {r6('sum(value)')} AS total, {r6('sum(value * t)')} AS moment FROM ts GROUP BY 1, 2"
)


def _series_summary(rows):
    out = rows.groupBy("subject_id", "roi").agg(
        F.count(F.lit(1)).alias("n_t"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("t")).alias("moment")
    )
    return round_columns(out, "total", "moment")


@register("read_roi_timeseries", _SERIES_SQL)
def read_roi_timeseries(spark, sf):
    return _series_summary(arrays.timeseries_rows(series_files(spark, sf, "/roi/sub{sid}/series.npy")))


@register("read_roi_timeseries_last_token", _SERIES_SQL)
def read_roi_timeseries_last_token(spark, sf):
    return _series_summary(arrays.timeseries_rows(series_files(spark, sf, "/roi/all/atlas_v2_{sid}.npy"), id_rule="last_token"))


@register("read_roi_timeseries_folder", _SERIES_SQL)
def read_roi_timeseries_folder(spark, sf):
    return _series_summary(arrays.timeseries_rows(series_files(spark, sf, "/roi/{sid}/atlas.npy"), id_rule="folder"))


@register(
    "read_tabular_features",
    sql(
        "emb tab",
        "SELECT subject_id, CASE WHEN CAST(subject_id AS BIGINT) % 17 = 0 THEN 1 ELSE 0 END AS n_nan, "
        f"{r6('round(f0 * 1000)')} AS f0, {r6('round(f2 * 1000)')} AS f2 FROM tab WHERE subject_id IN (SELECT subject_id FROM emb)",
    ),
)
def read_tabular_features(spark, sf):
    wide = fx.tab_nan(spark, sf).select(
        F.col("subject_id").alias("participant.eid"),
        *[(F.round(F.element_at("features", i + 1) * 1000) if i != 1 else F.element_at("features", 2)).alias(f"f{i}") for i in range(6)],
    )
    path = scratch_path(spark, "tabular")
    # A second, worse copy of every row follows the first one in its file.
    doubled = wide.withColumn("n", F.explode(F.array(F.lit(1), F.lit(-1)))).select(
        "`participant.eid`", *[(F.col(f"f{i}") * F.col("n")).alias(f"f{i}") for i in range(6)]
    )
    doubled.write.option("header", "true").csv(path)
    got = tables.read_tabular_features(spark, path, ids=fx.emb(spark, sf))
    return got.select("subject_id", F.isnan("f1").cast("int").alias("n_nan"), F.col("f0").cast("double"), F.col("f2").cast("double"))


def _part_names(spark, sf):
    return fx.table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@register(
    "read_name_list",
    "SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS position, p_brand AS name FROM (SELECT DISTINCT p_brand FROM part)",
)
def read_name_list(spark, sf):
    path = scratch_path(spark, "names")
    text = _part_names(spark, sf).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("  "), "p_brand", F.lit(" ")))), "\n\n").alias("value"))
    text.write.text(path)
    return tables.read_name_list(spark, path).withColumn("position", F.col("position").cast("int"))


@register(
    "read_feature_names",
    "SELECT CAST(d - 1 AS INTEGER) AS position, 'gene_' || CAST(d - 1 AS VARCHAR) AS name FROM range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)) AS r(d)",
)
def read_feature_names(spark, sf):
    width = fx.emb(spark, sf).agg(F.max(F.size("embedding"))).first()[0]
    return tables.read_feature_names(spark, width, "gene")


_DICTIONARY_SQL = (
    "SELECT p_brand AS \"column\", description, category FROM (SELECT p_brand, min(p_type) AS description, "
    "CASE WHEN count(*) % 2 = 0 THEN 'even' ELSE '' END AS category FROM part GROUP BY p_brand)"
)


def _dictionary(spark, sf):
    return fx.table(spark, sf, "part").groupBy("p_brand").agg(
        F.min("p_type").alias("description"), F.when(F.count(F.lit(1)) % 2 == 0, "even").otherwise("").alias("category")
    )


@register("read_field_dictionary", _DICTIONARY_SQL)
def read_field_dictionary(spark, sf):
    path = scratch_path(spark, "dictionary")
    rows = _dictionary(spark, sf).select(
        F.col("p_brand").alias("Column Name"), F.col("description").alias("Description"), F.col("category").alias("Category")
    )
    rows.write.option("header", "true").csv(path)
    return tables.read_field_dictionary(spark, path)


@register(
    "read_roi_labels",
    "SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS roi, n_name AS roi_name FROM nation",
)
def read_roi_labels(spark, sf):
    path = scratch_path(spark, "labels")
    n = fx.table(spark, sf, "nation")
    n.select(F.col("n_name").alias("ROI Name"), "n_regionkey").orderBy("ROI Name").coalesce(1).write.option("header", "true").csv(path)
    return tables.read_roi_labels(spark, path, expected=n.count()).withColumn("roi", F.col("roi").cast("int"))


def _result_files(spark, sf):
    """One JSON file per model and modality with a status, among them a broken file."""
    path = scratch_path(spark, "results")
    rows = fx.strat(spark, sf)
    status = F.when(F.col("modality") == "P", "RUNNING").otherwise("FINISHED")
    rows.withColumn("status", status).repartition("model", "modality").write.json(path)
    spark.range(1).select(F.lit("{\"model\": ").alias("value")).write.mode("append").text(path)
    return path


@register(
    "read_results",
    sql("strat", f"SELECT model, modality, {r6('r_diff')} AS r_diff, {r6('p_value')} AS p_value FROM strat WHERE modality <> 'P'"),
)
def read_results(spark, sf):
    schema = "model string, modality string, r_diff double, p_value double, status string"
    # One record per line here, so the reader runs without multi-line mode on these files.
    got = results.read_results(spark, _result_files(spark, sf), schema, multi_line=False)
    return round_columns(got.select("model", "modality", "r_diff", "p_value"), "r_diff", "p_value")


def _comparison(spark, sf):
    s = fx.strat(spark, sf)
    source = F.concat(F.regexp_replace("model", "[^A-Z]", ""), F.lit("_"), "modality", F.lit("_results.json"))
    return s.select(source.alias("source"), "r_diff", "p_value", "null_std")


_STRAT_PARSE = (
    "SELECT regexp_replace(model, '[^A-Z]', '', 'g') AS model, modality, r_diff, p_value, null_std FROM strat"
)


@register(
    "read_stratified_results",
    sql(
        "strat",
        f"SELECT model, modality, {r6('r_diff')} AS r_diff, {r6('p_value')} AS perm_p_value, {r6('null_std')} AS perm_null_std FROM s",
        s=_STRAT_PARSE,
    ),
)
def read_stratified_results(spark, sf):
    rows = _comparison(spark, sf)
    empty = F.lit(None).cast("double")
    comparison = rows.select("source", "r_diff", empty.alias("perm_p_value"), F.when(F.col("r_diff") > 0, F.col("null_std")).alias("perm_null_std"))
    permutation = rows.select("source", F.col("p_value").alias("perm_p_value"), F.col("null_std").alias("perm_null_std"))
    got = results.read_stratified_results(comparison, permutation)
    return round_columns(got.select("model", "modality", "r_diff", "perm_p_value", "perm_null_std"), "r_diff", "perm_p_value", "perm_null_std")


@register(
    "read_stratified_modalities",
    sql(
        "strat",
        f"SELECT m.modality, s.model, {r6('coalesce(s.r_diff, 0.0)')} AS r_diff FROM (VALUES ('F'), ('O'), ('absent')) AS m(modality) LEFT JOIN s USING (modality)",
        s=_STRAT_PARSE,
    ),
)
def read_stratified_modalities(spark, sf):
    rows = _comparison(spark, sf)
    got = results.read_stratified_results(rows.select("source", "r_diff"), modalities=["F", "O", "absent"])
    return round_columns(got.select("modality", "model", "r_diff"), "r_diff")


@register(
    "read_voxel_qc",
    "SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, " + r6("avg(l_discount)") + " AS overlap FROM lineitem GROUP BY l_orderkey HAVING count(*) > 2",
)
def read_voxel_qc(spark, sf):
    path = scratch_path(spark, "voxel")
    per_order = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("o"), F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("n") > 2, F.col("o").cast("string")).otherwise("n/a")
    per_order.select(F.col("l_orderkey").alias("subject_id"), text.alias("overlap")).write.option("header", "true").csv(path)
    return tables.read_voxel_qc(spark, path).select("subject_id", F.col("overlap")).transform(round_columns, "overlap")


# ---- sinks ----------------------------------------------------------------------


@register(
    "write_matrix",
    "SELECT count(*) AS n_rows, CAST(max(len(embedding)) AS BIGINT) AS n_features, 'vectors' AS tag FROM embeddings",
)
def write_matrix(spark, sf):
    path, meta = scratch_path(spark, "matrix"), scratch_path(spark, "matrix-meta")
    results.write_matrix(fx.emb(spark, sf).withColumnRenamed("embedding", "features"), path, meta, "vectors", ["label"])
    return spark.read.json(meta)


def _aligned(spark, sf):
    e = fx.emb(spark, sf).select("subject_id", "y", F.col("embedding").alias("x"))
    return align.attach_covariates(align.align_two(e, fx.tab(spark, sf).withColumnRenamed("features", "y_features")), fx.cov(spark, sf))


@register(
    "write_aligned_dataset",
    sql(
        "emb tab cov",
        "SELECT count(*) AS n_subjects, CAST(sum(y) AS BIGINT) AS n_case, CAST(sum(1 - y) AS BIGINT) AS n_control, CAST(64 AS BIGINT) AS x_dim, CAST(6 AS BIGINT) AS y_dim "
        "FROM emb JOIN tab USING (subject_id) JOIN cov USING (subject_id) WHERE valid",
    ),
)
def write_aligned_dataset(spark, sf):
    return results.write_aligned_dataset(_aligned(spark, sf), scratch_path(spark, "aligned"), scratch_path(spark, "aligned-meta"))


@register(
    "write_results",
    sql(
        "strat",
        "SELECT model, modality, round(r_diff, 4) + 0.0 AS r_diff, round(p_value, 4) + 0.0 AS p_value FROM strat",
    ),
)
def write_results(spark, sf):
    path = scratch_path(spark, "summary")
    results.write_results(reports.summary_table(fx.strat(spark, sf).select("model", "modality", "r_diff", "p_value")), path, "csv")
    back = spark.read.option("header", "true").schema("model string, modality string, r_diff double, p_value double").csv(path)
    return back.withColumns({c: F.col(c) + 0.0 for c in ("r_diff", "p_value")})


@register(
    "materialize_moments",
    "WITH z AS (SELECT CAST(vec_id % 5 AS INTEGER) AS fold, list_concat([1.0::DOUBLE], embedding) AS z FROM embeddings) "
    f"SELECT fold, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r6('sum(z[i + 1] * z[j + 1])')} AS s FROM z, range(65) AS a(i), range(65) AS b(j) WHERE i <= j GROUP BY 1, 2, 3",
)
def materialize_moments(spark, sf):
    from pairlens.operators.moments import z_vector

    e = fx.table(spark, sf, "embeddings").withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    path = scratch_path(spark, "moments")
    z = z_vector(None, F.col("embedding"))
    coupling.materialize_moments(coupling.split_moments(e, z), path)
    again = coupling.materialize_moments(coupling.split_moments(e.limit(0), z), path)  # served from the written table
    return round_columns(again.select("fold", "i", "j", "s"), "s")


@register(
    "resume_grid",
    "WITH dims AS (SELECT least(d, (SELECT max(len(embedding)) FROM embeddings)) AS d FROM (VALUES (8), (32), (512)) AS v(d)), "
    "cs AS (SELECT c::DOUBLE AS c FROM (VALUES (0.1), (0.3)) AS v(c)) "
    "SELECT position, method, dim, c1, c2 FROM (SELECT CAST(row_number() OVER (ORDER BY method, dim, c1, c2) - 1 AS INTEGER) AS position, method, CAST(dim AS INTEGER) AS dim, c1, c2 FROM "
    "(SELECT 'cca' AS method, d AS dim, 1.0::DOUBLE AS c1, 1.0::DOUBLE AS c2 FROM dims UNION ALL SELECT 'scca', d, a, b FROM dims, cs AS x(a), cs AS y(b))) "
    "WHERE NOT (method = 'cca' OR (dim = 8 AND c1 = 0.1::DOUBLE))",
)
def resume_grid(spark, sf):
    width = fx.emb(spark, sf).agg(F.max(F.size("embedding"))).first()[0]
    grid = reports.config_grid(spark, ["cca", "scca"], [8, 32, 512], [0.1, 0.3], width)
    done = grid.filter("method = 'cca' or (dim = 8 and c1 = 0.1)").select(config_label("method", "dim", "c1", "c2").alias("config"))
    return coupling.resume_grid(grid, done).select("position", "method", "dim", "c1", "c2")


@register(
    "dataset_fingerprint",
    "SELECT count(*) AS n, bit_xor(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(CAST(round(o_totalprice * 1000000) AS BIGINT) AS VARCHAR) || '|' || o_orderstatus), 1, 15) AS BIGINT)) AS fingerprint FROM orders",
)
def dataset_fingerprint(spark, sf):
    return results.dataset_fingerprint(fx.table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"])
