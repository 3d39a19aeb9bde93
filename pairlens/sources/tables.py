"""Text and CSV inputs: feature tables, name lists, dictionaries, quality tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.ranking import keep_first, keep_last


def _place() -> Column:
    """Where a row stands in its files, taken as they are read: file, start of the part, number within the task."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))


def read_tabular_features(
    spark: SparkSession, path: str, id_col: str = "participant.eid", ids: DataFrame | None = None, keep_order: bool = True
) -> DataFrame:
    """Wide CSV with a string id and float features as (subject_id, <features>), first row per id.

    The schema comes from the header alone (no inference pass); empty cells become NaN.
    """
    header = spark.read.option("header", "true").csv(path).columns
    if id_col not in header:
        raise ValueError(f"no id column {id_col!r} in {path}")
    schema = T.StructType([T.StructField(c, T.StringType() if c == id_col else T.FloatType()) for c in header])
    rows = spark.read.option("header", "true").option("enforceSchema", "true").schema(schema).csv(path)
    features = [c for c in header if c != id_col]
    clean = rows.select(
        _place().alias("_pos"),
        F.trim(F.col(f"`{id_col}`")).alias("subject_id"),
        *[F.coalesce(F.col(f"`{c}`"), F.lit(float("nan")).cast("float")).alias(c) for c in features],
    )
    if ids is not None:
        clean = clean.join(ids.select("subject_id"), "subject_id", "left_semi")
    if not keep_order:
        return clean.drop("_pos").dropDuplicates(["subject_id"])
    return keep_first(clean, "subject_id", "_pos").drop("_pos")


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank stripped lines with their 0-based position. Name lists are metadata-sized."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("_p", "_l"))
    clean = lines.select("_p", F.trim("_l").alias("name")).filter("name <> ''")
    from pyspark.sql import Window

    return clean.select((F.row_number().over(Window.orderBy("_p")) - 1).alias("position"), "name")


def read_feature_names(spark: SparkSession, n: int, prefix: str, path: str | None = None) -> DataFrame:
    """(position, name) for n features from a list of that length, or generated `prefix_i`."""
    generated = F.concat(F.lit(f"{prefix}_"), F.col("position").cast("string"))
    base = spark.range(n).select(F.col("id").cast("int").alias("position"))
    if path is None:
        return base.withColumn("name", generated)
    names = read_name_list(spark, path)
    got = names.count()
    if got != n:
        raise ValueError(f"name list has {got} entries, expected {n}")
    return base.join(names, "position", "left").withColumn("name", F.coalesce("name", generated))


def read_field_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(column, description, category) from a CSV that must have `Column Name` and `Description`."""
    df = spark.read.option("header", "true").csv(path)
    missing = {"Column Name", "Description"} - set(df.columns)
    if missing:
        raise ValueError(f"dictionary lacks {sorted(missing)}")
    category = F.coalesce(F.trim("Category"), F.lit("")) if "Category" in df.columns else F.lit("")
    rows = df.select(
        _place().alias("_pos"), F.trim("`Column Name`").alias("column"), F.coalesce(F.trim("Description"), F.lit("")).alias("description"), category.alias("category")
    )
    return keep_last(rows.filter("column is not null and column <> ''"), "column", "_pos").drop("_pos")


def read_roi_labels(spark: SparkSession, path: str, expected: int = 400) -> DataFrame:
    """(roi, roi_name) in file order; the number of rows is checked."""
    df = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    if "ROI Name" not in df.columns:
        raise ValueError("label table lacks 'ROI Name'")
    from pyspark.sql import Window

    rows = df.select(F.col("ROI Name").alias("roi_name"), _place().alias("_p"))
    out = rows.select((F.row_number().over(Window.orderBy("_p")) - 1).alias("roi"), "roi_name")
    n = out.count()
    if n != expected:
        raise ValueError(f"expected {expected} regions, got {n}")
    return out


def read_voxel_qc(spark: SparkSession, path: str) -> DataFrame:
    """Per-subject overlap fraction and status; non-numeric overlaps are ignored."""
    df = spark.read.option("header", "true").csv(path)
    return df.withColumn("overlap", F.expr("try_cast(overlap AS double)")).filter("overlap is not null")
