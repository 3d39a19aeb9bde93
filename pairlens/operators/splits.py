"""Deterministic shuffled holdouts and folds.

Order comes from md5(id|seed), so membership is the same in every engine and on
every cluster size. Counts per split equal those of the usual shuffled splitters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.ranking import hash_rank


def _class_quota(label: str, fraction: float):
    """Annotate bucket sizes with the holdout rows of the class: ceil(fraction * n) in total,
    shared by largest remainder."""

    def annotate(sizes: DataFrame) -> DataFrame:
        classes = sizes.groupBy(label).agg(F.sum("_n").alias("_class"))
        everything = Window.partitionBy()  # one row per class reaches these windows
        want = F.ceil(F.lit(fraction) * F.col("_total"))
        share = want * F.col("_class") / F.col("_total")
        quota = (
            classes.withColumn("_total", F.sum("_class").over(everything))
            .withColumn("_base", F.floor(share))
            .withColumn("_rest", share - F.floor(share))
            .withColumn("_missing", want - F.sum("_base").over(everything))
        )
        by_rest = Window.partitionBy().orderBy(F.col("_rest").desc(), F.col(label))
        extra = (F.row_number().over(by_rest) <= F.col("_missing")).cast("long")
        return sizes.join(quota.select(label, (F.col("_base") + extra).alias("_quota")), label)

    return annotate


def _group_quota(keys: list[str], fraction: float):
    """Annotate bucket sizes with ceil(fraction * n) of their key."""
    total = F.sum("_n").over(Window.partitionBy(*keys))  # one row per bucket
    return lambda sizes: sizes.withColumn("_quota", F.ceil(F.lit(fraction) * total))


def _holdout(ranked: DataFrame) -> DataFrame:
    split = F.when(F.col("_rank") <= F.col("_quota"), "holdout").otherwise("train")
    return ranked.withColumn("split", split).drop("_rank", "_quota")


def stratified_holdout(
    df: DataFrame, label: str = "y", id_col: str = "subject_id", fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `split` = holdout/train with class proportions kept."""
    return _holdout(hash_rank(df, [label], id_col, seed, "_rank", annotate=_class_quota(label, fraction)))


def shuffle_holdout(
    df: DataFrame, id_col: str = "subject_id", fraction: float = 0.2, seed: int = 42, group: str | None = None
) -> DataFrame:
    """Add `split` with ceil(fraction * n) holdout rows, per group when one is given."""
    keys = [group] if group else []
    return _holdout(hash_rank(df, keys, id_col, seed, "_rank", annotate=_group_quota(keys, fraction)))


def holdout_and_folds(
    df: DataFrame,
    n_folds: int = 5,
    fraction: float = 0.2,
    seed: int = 42,
    id_col: str = "subject_id",
    label: str | None = "y",
    group: str | None = None,
    holdout_fold: int = -1,
) -> DataFrame:
    """Add `fold`: the holdout mark, or the validation fold of a training row.

    Stratified by `label`; with `group` each group is split on its own instead. The first
    rows in hash order form the holdout and the rest are dealt to the folds, so one
    ranking serves both.
    """
    if group is None and label is not None:
        keys, annotate = [label], _class_quota(label, fraction)
    else:
        keys = [group] if group else []
        annotate = _group_quota(keys, fraction)
    ranked = hash_rank(df, keys, id_col, seed, "_rank", annotate=annotate)
    dealt = F.pmod(F.col("_rank") - F.col("_quota") - 1, F.lit(n_folds)).cast("int")
    fold = F.when(F.col("_rank") <= F.col("_quota"), holdout_fold).otherwise(dealt)
    return ranked.withColumn("fold", fold).drop("_rank", "_quota")


def kfold(
    df: DataFrame, k: int = 5, id_col: str = "subject_id", seed: int = 42, label: str | None = None
) -> DataFrame:
    """Add `fold` in 0..k-1, dealt in hash order; with `label` each class is dealt separately."""
    ranked = hash_rank(df, [label] if label else [], id_col, seed, "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def stratified_kfold(df: DataFrame, k: int = 5, label: str = "y", id_col: str = "subject_id", seed: int = 42) -> DataFrame:
    return kfold(df, k, id_col, seed, label)


def split_by_label(df: DataFrame, label: str = "y", group: str = "grp", names: tuple[str, str] = ("control", "case")) -> DataFrame:
    """Name the two label groups; later operators take the column as a grouping key."""
    return df.withColumn(group, F.when(F.col(label) == 1, names[1]).otherwise(names[0]))


def binarize_label(df: DataFrame, label: str = "y", out: str = "y") -> DataFrame:
    """Map a two-valued label to 0/1, larger value to 1; any other number of values is an error."""
    bounds = df.agg(F.struct(F.min(label).alias("lo"), F.max(label).alias("hi")).alias("b"))
    value = F.col(label)
    mapped = (
        F.when(value.isin(0, 1) & (F.col("_b.lo") >= 0) & (F.col("_b.hi") <= 1), value.cast("int"))
        .when((value == F.col("_b.lo")) & (F.col("_b.lo") < F.col("_b.hi")), 0)
        .when((value == F.col("_b.hi")) & (F.col("_b.lo") < F.col("_b.hi")), 1)
        .otherwise(F.raise_error(F.lit("label must take exactly two values")).cast("int"))
    )
    return df.withColumn("_b", bounds.scalar()).withColumn(out, mapped).drop("_b")


def class_counts(df: DataFrame, keys: list[str], label: str = "y") -> DataFrame:
    y = F.col(label).cast("long")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("n_case"),
        F.sum(1 - y).alias("n_control"),
        F.avg(y).alias("prevalence"),
    )
