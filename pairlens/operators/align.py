"""Keyed alignment of views, id-set operations and lookup joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.ranking import keep_first, keep_last


def _dedupe(df: DataFrame, key: str, position: str | None, keep: str) -> DataFrame:
    if position is None:
        return df
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', got {keep!r}")
    pick = keep_first if keep == "first" else keep_last
    return pick(df, key, position).drop(position)


def align_two(
    a: DataFrame, b: DataFrame, key: str = "subject_id", position: str | None = None, keep: str = "first"
) -> DataFrame:
    """Inner join of two views on the id, one row per id on each side."""
    return _dedupe(a, key, position, keep).join(_dedupe(b, key, position, keep), key)


def align_three(
    a: DataFrame,
    b: DataFrame,
    labels: DataFrame,
    key: str = "subject_id",
    position: str | None = None,
    keep: str = "last",
) -> DataFrame:
    """Inner join of two views and a label table; duplicates keep the last row by default."""
    return align_two(a, b, key, position, keep).join(_dedupe(labels, key, position, keep), key)


def require_rows(df: DataFrame, message: str = "no aligned rows") -> DataFrame:
    """Fail early when an alignment is empty (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def apply_valid_mask(covariates: DataFrame, mask: str = "valid") -> DataFrame:
    return covariates.filter(F.col(mask)).drop(mask)


def attach_covariates(df: DataFrame, covariates: DataFrame, key: str = "subject_id", mask: str = "valid") -> DataFrame:
    """Join the valid covariates; subjects without them are dropped."""
    return df.join(apply_valid_mask(covariates, mask), key)


def attach_labels(df: DataFrame, labels: DataFrame, key: str = "subject_id") -> DataFrame:
    """Label lookup by id; the validity mask plays no part here."""
    return df.join(labels, key)


def ids_intersect(*id_sets: DataFrame) -> DataFrame:
    out = id_sets[0]
    for other in id_sets[1:]:
        out = out.intersect(other)
    return out


def ids_missing(wanted: DataFrame, available: DataFrame, key: str = "subject_id") -> DataFrame:
    """Requested ids that the other table does not hold."""
    return wanted.select(key).distinct().join(available.select(key).distinct(), key, "left_anti")


def take_in_order(ids: DataFrame, data: DataFrame, key: str = "subject_id", position: str = "pos", strict: bool = True) -> DataFrame:
    """Rows of `data` for the requested ids with their requested position.

    The order itself is a column; sort at the sink. With `strict` an absent id fails
    the query while it runs, without a second pass over the data.
    """
    hit = data.withColumn("_hit", F.lit(True))
    joined = ids.select(key, position).join(hit, key, "left" if strict else "inner")
    if strict:
        message = F.concat(F.lit("requested id is absent: "), F.col(key).cast("string"))
        joined = joined.withColumn(
            key, F.when(F.col("_hit"), F.col(key)).otherwise(F.raise_error(message).cast(ids.schema[key].dataType))
        )
    return joined.drop("_hit")


subset_by_ids = take_in_order


def reorder_or_align(ids: DataFrame, data: DataFrame, key: str = "subject_id", position: str = "pos") -> DataFrame:
    """Bring `data` to the order of `ids`; equal sets reorder, larger data are gathered."""
    return take_in_order(ids, data, key, position, strict=True)


def semi_available(ids: DataFrame, available: DataFrame, key: str = "subject_id") -> DataFrame:
    """Ids (with all their columns) that have at least one row in `available`."""
    return ids.join(available.select(key), key, "left_semi")


def limit_subjects(df: DataFrame, n: int, key: str = "subject_id") -> DataFrame:
    """All rows of the n lowest ids; the trim happens per task before anything is joined."""
    ids = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(ids, key, "left_semi")


def join_tabular(
    a: DataFrame, b: DataFrame, covariates: DataFrame, key: str = "subject_id", features: str = "features"
) -> DataFrame:
    """Inner join of two feature tables and covariates with concatenated feature arrays."""
    left = a.select(key, F.col(features).alias("_fa"))
    right = b.select(key, F.col(features).alias("_fb"))
    return (
        left.join(right, key).join(covariates, key).withColumn(features, F.concat("_fa", "_fb")).drop("_fa", "_fb")
    )


def attach_feature_names(columns: DataFrame, dictionary: DataFrame, include_col: bool = False) -> DataFrame:
    """Display name per feature column from a (column, description, category) dictionary."""
    from pairlens.functions.labels import display_name

    lookup = dictionary.withColumn("_known", F.lit(True))
    return columns.join(lookup, "column", "left").select(
        *columns.columns,
        display_name("column", "description", "category", include_col).alias("name"),
        F.col("_known").isNull().alias("is_missing"),
    )


def cumulative_offset(chunks: DataFrame, key: str, chunk: str, n: str, offset: str = "row_offset") -> DataFrame:
    """Rows before each chunk of a key; the input has one row per chunk file."""
    w = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn(offset, F.coalesce(F.sum(n).over(w), F.lit(0)))


def global_row_index(rows: DataFrame, key: str, chunk: str, row_in_chunk: str, index: str = "row_idx") -> DataFrame:
    """Global row number of (chunk, row in chunk) per key from running chunk lengths."""
    sizes = rows.groupBy(key, chunk).agg(F.count(F.lit(1)).alias("_n"))
    offsets = cumulative_offset(sizes, key, chunk, "_n", "_off").drop("_n")
    return rows.join(offsets, [key, chunk]).withColumn(index, F.col("_off") + F.col(row_in_chunk)).drop("_off")


def sort_custom_order(df: DataFrame, orders: dict[str, Sequence[str]], position: str = "sort_pos") -> DataFrame:
    """Add a sortable struct of fixed-order positions, unknown values after all known ones."""
    parts: list[Column] = []
    for column, values in orders.items():
        # array_position is 1-based and 0 for absent values.
        pos = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
        parts.append(F.when(pos > 0, pos - 1).otherwise(len(values)).alias(column))
    return df.withColumn(position, F.struct(*parts))
