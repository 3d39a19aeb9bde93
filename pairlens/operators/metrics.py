"""Exact classification metrics as distributed aggregations.

Scores are first collapsed to one row per distinct (key, score), then ordered in
buckets (`running_totals`), so neither a hot key nor a hot score value ends up whole
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.ranking import running_totals


def _score_steps(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; partial sums collapse hot scores before the shuffle."""
    y = F.col(label).cast("long")
    return df.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def ranking_metrics(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "y",
    score: str = "score",
    single_class_auc: float | None = None,
    buckets: int = 64,
) -> DataFrame:
    """ROC AUC (ties count half) and step-wise average precision per key.

    A key with one class has no AUC; `single_class_auc` replaces it (0.5 in the
    two-stage prediction). Average precision is NULL without a positive.
    """
    keys = list(keys)
    raw = df.select(F.col(score).cast("double").alias("_score"))
    steps = running_totals(_score_steps(df, keys, label, score), keys, "_score", ["pos", "neg"], buckets, True, raw)
    joined = steps.withColumnsRenamed({"pos_total": "_p", "neg_total": "_n"})
    tp = F.col("_p") - F.col("pos_before")  # positives at or above this score
    fp = F.col("_n") - F.col("neg_before")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.max("_p") * F.max("_n")
    auc = F.when(pairs > 0, wins / pairs)
    if single_class_auc is not None:
        auc = F.coalesce(auc, F.lit(float(single_class_auc)))
    ap = F.when(F.max("_p") > 0, F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp))) / F.max("_p"))
    return joined.groupBy(*keys).agg(
        (F.max("_p") + F.max("_n")).alias("n"), F.max("_p").alias("n_pos"), auc.alias("auc"), F.coalesce(ap, F.when(F.max("_p") > 0, 0.0)).alias("ap")
    )


def roc_auc(df: DataFrame, keys: Sequence[str], label: str = "y", score: str = "score", single_class_auc: float | None = None) -> DataFrame:
    return ranking_metrics(df, keys, label, score, single_class_auc).drop("ap")


def average_precision(df: DataFrame, keys: Sequence[str], label: str = "y", score: str = "score") -> DataFrame:
    return ranking_metrics(df, keys, label, score).drop("auc")


def confusion_matrix(df: DataFrame, keys: Sequence[str], label: str = "y", predicted: str = "yhat") -> DataFrame:
    """2 x 2 counts, zero cells included."""
    y, p = F.col(label), F.col(predicted)
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    return df.groupBy(*keys).agg(*[F.count_if((y == a) & (p == b)).alias(name) for name, a, b in cells])


def classification_metrics(df: DataFrame, keys: Sequence[str], label: str = "y", predicted: str = "yhat") -> DataFrame:
    """Accuracy, precision, recall and F1; a zero denominator gives 0."""
    cm = confusion_matrix(df, keys, label, predicted)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(num, den):
        return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))

    return cm.select(
        *keys,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def fold_summary(per_fold: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population sd of metrics over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.groupBy(*keys).agg(*aggs)
