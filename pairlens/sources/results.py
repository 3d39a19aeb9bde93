"""Result records: reading JSON sweeps, writing summaries and aligned datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def read_results(spark: SparkSession, glob: str, schema: T.StructType | str | None = None, status: str | None = "FINISHED", multi_line: bool = True) -> DataFrame:
    """Nested result files with their source name; invalid JSON and unfinished runs are skipped."""
    reader = spark.read.option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if schema is not None:
        full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if "_corrupt_record" not in full.names:
            full = T.StructType(full.fields + [T.StructField("_corrupt_record", T.StringType())])
        reader = reader.schema(full)
    df = reader.json(glob).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1))
    if "_corrupt_record" in df.columns:
        # Used together with the data columns, so the reader keeps parsing them.
        df = df.filter("_corrupt_record is null").drop("_corrupt_record")
    if status is not None and "status" in df.columns:
        df = df.filter(F.col("status") == status)
    return df


def split_model_modality(source) -> tuple:
    """(model, modality) from `<model>_<modality>_...`, cut at the first underscore."""
    stem = F.regexp_replace(F.col(source) if isinstance(source, str) else source, r"_results\.json$|\.json$", "")
    return F.regexp_extract(stem, r"^([^_]+)_(.+)$", 1), F.regexp_extract(stem, r"^([^_]+)_(.+)$", 2)


def read_stratified_results(
    comparison: DataFrame, permutation: DataFrame | None = None, modalities: Sequence[str] | None = None
) -> DataFrame:
    """Comparison rows with model and modality from their source, p-value and null sd from either table.

    With `modalities` every listed one gives a row; absent ones get 0.0 differences.
    """
    model, modality = split_model_modality("source")
    rows = comparison.withColumn("model", model).withColumn("modality", modality)
    if permutation is not None:
        pm, pd = split_model_modality("source")
        perm = permutation.select(
            pm.alias("model"), pd.alias("modality"), F.col("perm_p_value").alias("_p"), F.col("perm_null_std").alias("_s")
        )
        rows = rows.join(perm, ["model", "modality"], "left").withColumns(
            {"perm_p_value": F.coalesce("perm_p_value", "_p"), "perm_null_std": F.coalesce("perm_null_std", "_s")}
        ).drop("_p", "_s")
    if modalities is not None:
        dim = comparison.sparkSession.createDataFrame([(m,) for m in modalities], "modality string")
        rows = dim.join(rows, "modality", "left").na.fill(0.0, ["r_diff"])
    return rows


def write_results(results: DataFrame, path: str, fmt: str = "json") -> None:
    writer = results.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)


def write_matrix(df: DataFrame, path: str, meta_path: str, tag: str, partition_by: Sequence[str] = (), features: str = "features") -> None:
    """Matrix rows keyed by subject as Parquet, with a one-row JSON description."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    back = df.sparkSession.read.parquet(path)
    back.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size(features)).alias("n_features"), F.lit(tag).alias("tag")
    ).write.mode("overwrite").json(meta_path)


def aligned_meta(df: DataFrame, x: str = "x", y: str = "y_features", label: str = "y") -> DataFrame:
    """Counts per class and widths of an aligned dataset."""
    lab = F.col(label).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_subjects"), F.sum(lab).alias("n_case"), F.sum(1 - lab).alias("n_control"),
        F.max(F.size(x)).cast("long").alias("x_dim"), F.max(F.size(y)).cast("long").alias("y_dim"),
    )


def write_aligned_dataset(df: DataFrame, path: str, meta_path: str, x: str = "x", y: str = "y_features", label: str = "y") -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    meta = aligned_meta(df.sparkSession.read.parquet(path), x, y, label)
    meta.write.mode("overwrite").json(meta_path)
    return meta


def dataset_fingerprint(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Order-free content hash: xor of the leading 60 md5 bits of every row, with the row count.

    Engine-independent, so caches written elsewhere can be compared. Doubles enter
    rounded to integers of 10**-digits.
    """
    parts = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        if kind in ("double", "float"):
            parts.append(F.round(F.col(c) * 10**digits, 0).cast("long").cast("string"))
        else:
            parts.append(F.col(c).cast("string"))
    h = F.md5(F.concat_ws("|", *parts))
    bits = F.conv(F.substring(h, 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(bits).alias("fingerprint"))


__all__ = ["aligned_meta", "dataset_fingerprint", "read_results", "read_stratified_results", "split_model_modality", "write_aligned_dataset", "write_matrix", "write_results"]
