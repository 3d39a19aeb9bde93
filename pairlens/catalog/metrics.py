"""Classification metrics and permutation p-values on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.catalog.fixtures import r6, round_columns, sql
from pairlens.catalog.registry import register
from pairlens.operators import metrics, reports


def auc_sql(source: str, keys: str, score: str) -> str:
    """Mann-Whitney AUC with average ranks, per keys."""
    return (
        f"SELECT {keys}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS auc FROM "
        f"(SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0::DOUBLE AS rk FROM {source}) GROUP BY {keys}"
    )


def ap_sql(source: str, keys: str, score: str) -> str:
    """Step-wise average precision over distinct thresholds, per keys."""
    return (
        f"SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM (SELECT {keys}, {score}, pos, n, "
        f"CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(n - pos) OVER w AS DOUBLE) AS fp FROM (SELECT {keys}, {score}, sum(y) AS pos, count(*) AS n FROM {source} GROUP BY {keys}, {score}) "
        f"WINDOW w AS (PARTITION BY {keys} ORDER BY {score} DESC)) GROUP BY {keys}"
    )


def _auc(name: str) -> str:
    return f"SELECT fold, n, n_pos, {r6('auc')} AS auc FROM ({auc_sql('scores', 'fold', name)})"


@register("roc_auc", sql("scores", _auc("score")))
def roc_auc(spark, sf):
    return round_columns(metrics.roc_auc(fx.scores(spark, sf), ["fold"]), "auc")


@register("roc_auc_ties", sql("scores", _auc("tied")))
def roc_auc_ties(spark, sf):
    return round_columns(metrics.roc_auc(fx.scores(spark, sf), ["fold"], score="tied"), "auc")


@register("roc_auc_lines", sql("line_scores", f"SELECT grp, n, n_pos, {r6('auc')} AS auc FROM ({auc_sql('line_scores', 'grp', 'score')})"))
def roc_auc_lines(spark, sf):
    """Every order line; eleven distinct scores, so whole score groups collapse before the shuffle."""
    return round_columns(metrics.roc_auc(fx.line_scores(spark, sf), ["grp"]), "auc")


@register(
    "roc_auc_single_class",
    "SELECT brand, n, n_pos, CASE WHEN n_pos = 0 OR n_pos = n THEN 0.5::DOUBLE ELSE " + r6("auc") + " END AS auc FROM ("
    + auc_sql("(SELECT p_brand AS brand, CAST(p_size > 48 AS INTEGER) AS y, p_retailprice AS score FROM part)", "brand", "score").replace(
        "(sum(y) * sum(1 - y))", "nullif(sum(y) * sum(1 - y), 0)"
    )
    + ")",
)
def roc_auc_single_class(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") > 48).cast("int").alias("y"), F.col("p_retailprice").alias("score"))
    return round_columns(metrics.roc_auc(p, ["brand"], single_class_auc=0.5), "auc")


@register("average_precision", sql("scores", f"SELECT fold, n, n_pos, {r6('ap')} AS ap FROM ({ap_sql('scores', 'fold', 'score')})"))
def average_precision(spark, sf):
    return round_columns(metrics.average_precision(fx.scores(spark, sf), ["fold"]), "ap")


@register("average_precision_lines", sql("line_scores", f"SELECT grp, n, n_pos, {r6('ap')} AS ap FROM ({ap_sql('line_scores', 'grp', 'score')})"))
def average_precision_lines(spark, sf):
    return round_columns(metrics.average_precision(fx.line_scores(spark, sf), ["grp"]), "ap")


_CM = "SELECT grp, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp FROM line_scores GROUP BY grp"


@register("confusion_matrix", sql("line_scores", _CM))
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(fx.line_scores(spark, sf), ["grp"])


@register(
    "classification_metrics",
    sql(
        "line_scores",
        f"SELECT grp, {r6('(tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE)')} AS accuracy, {r6('coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0)')} AS precision, "
        f"{r6('coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0)')} AS recall, {r6('coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0)')} AS f1 FROM ({_CM})",
    ),
)
def classification_metrics(spark, sf):
    return round_columns(metrics.classification_metrics(fx.line_scores(spark, sf), ["grp"]), "accuracy", "precision", "recall", "f1")


@register(
    "fold_metric_summary",
    sql("scores", f"SELECT 'linear' AS model, {r6('avg(auc)')} AS auc_mean, {r6('stddev_pop(auc)')} AS auc_std FROM ({auc_sql('scores', 'fold', 'score')})"),
)
def fold_metric_summary(spark, sf):
    per_fold = metrics.roc_auc(fx.scores(spark, sf), ["fold"]).withColumn("model", F.lit("linear"))
    return round_columns(metrics.fold_summary(per_fold, ["model"], ["auc"]), "auc_mean", "auc_std")


_NULL = "SELECT o_orderstatus AS component, o_totalprice / 100000 AS r FROM orders"
_OBS = "SELECT component, avg(r) + stddev_pop(r) AS r_obs FROM nulls GROUP BY component"


def _null(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select(F.col("o_orderstatus").alias("component"), (F.col("o_totalprice") / 100000).alias("r"))


@register(
    "perm_pvalue_one_sided",
    sql(
        "",
        f"SELECT component, {r6('max(r_obs)')} AS r_obs, count(*) AS n_perm, {r6('(count(*) FILTER (WHERE r >= r_obs) + 1) / CAST(count(*) + 1 AS DOUBLE)')} AS p_value FROM nulls JOIN obs USING (component) GROUP BY component",
        nulls=_NULL,
        obs=_OBS,
    ),
)
def perm_pvalue_one_sided(spark, sf):
    null = _null(spark, sf)
    observed = null.groupBy("component").agg((F.avg("r") + F.stddev_pop("r")).alias("r_obs"))
    return round_columns(reports.perm_pvalue(null, observed, ["component"]), "r_obs", "p_value")


@register(
    "perm_pvalue_two_sided",
    sql(
        "",
        f"SELECT component, {r6('max(o)')} AS obs_diff, count(*) AS n_perm, {r6('avg(d)')} AS null_mean, {r6('stddev_pop(d)')} AS null_std, {r6('avg(CAST(abs(d) >= abs(o) AS INTEGER))')} AS p_value "
        "FROM (SELECT component, r - 2.5 AS d, r_obs - 2.5 AS o FROM nulls JOIN obs USING (component)) GROUP BY component",
        nulls=_NULL,
        obs=_OBS,
    ),
)
def perm_pvalue_two_sided(spark, sf):
    null = _null(spark, sf)
    observed = null.groupBy("component").agg((F.avg("r") + F.stddev_pop("r") - 2.5).alias("obs_diff"))
    got = reports.perm_pvalue_two_sided(null.withColumn("diff", F.col("r") - 2.5), observed, ["component"])
    return round_columns(got, "obs_diff", "null_mean", "null_std", "p_value")
