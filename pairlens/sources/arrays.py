"""Array files (one 2-D .npy per file) as long tables.

The listing and the id rules are DataFrame expressions over file paths; only decoding
one file into rows happens in Python, batch by batch on the executors.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.align import global_row_index


def list_files(spark: SparkSession, root: str, glob: str = "*.npy") -> DataFrame:
    """(path, content) of matching files below root; content is read only where it is used."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")
    )


BATCH_CELLS = 1_000_000  # values of decoded files that leave a task at once; a larger file leaves alone


def _decode(files: DataFrame, keep: Sequence[str], rows_of, fields: list[T.StructField]) -> DataFrame:
    """Rows of every file with its `keep` columns. Small files leave in common batches: one of its own costs more than decoding a file."""
    schema = T.StructType([files.schema[c] for c in keep] + fields)

    def run(batches):
        parts: list[dict] = []
        heads: list[tuple] = []
        cells = 0

        def together() -> pd.DataFrame:
            sizes = [len(part[fields[0].name]) for part in parts]
            out = {c: pd.Series([h[i] for h in heads], dtype=object).repeat(sizes).to_numpy() for i, c in enumerate(keep)}
            for f in fields:
                columns = [part[f.name] for part in parts]
                out[f.name] = list(chain.from_iterable(columns)) if isinstance(f.dataType, T.ArrayType) else np.concatenate(columns)
            return pd.DataFrame(out)

        for pdf in batches:
            for *head, content in zip(*[pdf[c] for c in [*keep, "content"]]):
                arr = np.load(io.BytesIO(content), allow_pickle=False)
                parts.append(rows_of(arr))
                heads.append(head)
                cells += arr.size
                if cells >= BATCH_CELLS:
                    yield together()
                    parts, heads, cells = [], [], 0
        if parts:
            yield together()

    return files.select(*keep, "content").mapInPandas(run, schema)


def _embedding_rows(arr: np.ndarray) -> dict:
    if arr.ndim != 2:
        raise ValueError(f"expected a 2-D chunk, got shape {arr.shape}")
    return {"row_in_chunk": np.arange(len(arr)), "embedding": list(arr.astype(np.float32))}


def _series_rows(arr: np.ndarray) -> dict:
    if arr.ndim != 2:
        raise ValueError(f"expected a 2-D series, got shape {arr.shape}")
    if arr.shape[0] < arr.shape[1]:
        arr = arr.T
    t, r = np.indices(arr.shape, dtype=np.int32)
    return {"t": t.ravel(), "roi": r.ravel(), "value": arr.ravel().astype(np.float64)}


def _oriented_rows(arr: np.ndarray) -> dict:
    if arr.ndim != 2:
        raise ValueError(f"expected a 2-D series, got shape {arr.shape}")
    arr = arr.T if arr.shape[0] < arr.shape[1] else arr
    return {"t": np.arange(len(arr), dtype=np.int32), "values": list(arr.astype(np.float64))}


CHUNK_PATTERN = r"embeddings_(\d+)_layer_last\.npy$"


def embedding_catalog(files: DataFrame, pattern: str = CHUNK_PATTERN) -> DataFrame:
    """Gene (parent folder) and numeric chunk of every matching file; others are skipped."""
    chunk = F.regexp_extract("path", pattern, 1)
    gene = F.element_at(F.split("path", "/"), -2)
    return files.withColumn("gene", gene).withColumn("chunk", F.nullif(chunk, F.lit("")).cast("int")).filter("chunk is not null")


def incomplete_genes(catalog: DataFrame, n_files: int) -> DataFrame:
    """Genes whose number of chunk files differs from the expected one."""
    return catalog.groupBy("gene").agg(F.countDistinct("chunk").alias("n_files")).filter(F.col("n_files") != n_files)


def embedding_rows(
    files: DataFrame, pattern: str = CHUNK_PATTERN, n_files: int | None = None, skip_incomplete: bool = False
) -> DataFrame:
    """(gene, chunk, row_in_chunk, row_idx, embedding) from (path, content), chunks in numeric order.

    With `n_files`, a gene with another number of chunks is an error or, with
    `skip_incomplete`, left out.
    """
    catalog = embedding_catalog(files, pattern)
    if n_files is not None:
        bad = incomplete_genes(catalog.drop("content"), n_files)
        if skip_incomplete:
            catalog = catalog.join(bad.select("gene"), "gene", "left_anti")
        elif not bad.isEmpty():
            raise ValueError(f"genes with missing chunks: {[r.gene for r in bad.limit(5).collect()]}")
    rows = _decode(
        catalog, ["gene", "chunk"], _embedding_rows,
        [T.StructField("row_in_chunk", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))],
    )
    return global_row_index(rows, "gene", "chunk", "row_in_chunk")


def read_embedding_chunks(spark: SparkSession, root: str, glob: str = "*.npy", **options) -> DataFrame:
    """`embedding_rows` of all matching files below root."""
    return embedding_rows(list_files(spark, root, glob), **options)


def check_row_count(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Genes whose number of rows differs from the number of ids."""
    n = ids.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return rows.groupBy("gene").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_ids", n).filter("n_rows <> n_ids")


read_embedding_catalog = read_embedding_chunks


def subject_of_path(path: str | Column, rule: str = "folder_regex", regex: str = r"(\d+)") -> Column:
    """Subject id of a file: regex on the parent folder with the file name as fallback, the last
    `_` token of the file stem, or the folder name itself."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    folder, name = F.element_at(parts, -2), F.element_at(parts, -1)
    if rule == "folder_regex":
        hit = F.regexp_extract(folder, regex, 1)
        return F.when(hit != "", hit).otherwise(F.nullif(F.regexp_extract(name, regex, 1), F.lit("")))
    if rule == "last_token":
        return F.element_at(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_"), -1)
    if rule == "folder":
        return folder
    raise ValueError(f"unknown id rule: {rule}")


def _series_files(files: DataFrame, id_rule: str, regex: str, limit: int | None, ids: DataFrame | None) -> DataFrame:
    """(subject_id, content) with one file per subject; the first path wins."""
    files = files.withColumn("subject_id", subject_of_path("path", id_rule, regex))
    # Choose the files by path first, so content is carried for the chosen ones only.
    chosen = files.filter("subject_id is not null").groupBy("subject_id").agg(F.min("path").alias("path"))
    if ids is not None:
        chosen = chosen.join(ids.select("subject_id"), "subject_id", "left_semi")
    if limit is not None:
        chosen = chosen.orderBy("subject_id").limit(limit)
    return files.join(chosen, ["subject_id", "path"], "left_semi")


def timeseries_rows(
    files: DataFrame, id_rule: str = "folder_regex", regex: str = r"(\d+)", limit: int | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Long (subject_id, t, roi, value) series from (path, content), oriented time by region."""
    fields = [T.StructField("t", T.IntegerType()), T.StructField("roi", T.IntegerType()), T.StructField("value", T.DoubleType())]
    return _decode(_series_files(files, id_rule, regex, limit, ids), ["subject_id"], _series_rows, fields)


def timeseries_vector_rows(
    files: DataFrame, id_rule: str = "folder_regex", regex: str = r"(\d+)", limit: int | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """(subject_id, t, values[R]) rows, the form `fc_edges_of_vectors` takes without another shuffle."""
    fields = [T.StructField("t", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))]
    return _decode(_series_files(files, id_rule, regex, limit, ids), ["subject_id"], _oriented_rows, fields)


def read_roi_timeseries(spark: SparkSession, root: str, glob: str = "*.npy", **options) -> DataFrame:
    """`timeseries_rows` of all matching files below root."""
    return timeseries_rows(list_files(spark, root, glob), **options)
