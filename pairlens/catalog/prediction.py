"""Classifiers on linear representations of the paired vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog.estimators import _SPLIT, L_2X2, L_FULL, cca22, pairs, psql, z_2x2, z_full
from pairlens.catalog.fixtures import r6, round_columns
from pairlens.catalog.metrics import ap_sql, auc_sql
from pairlens.catalog.registry import register
from pairlens.catalog.wide import _FOLD_PARTS, gene_blocks, whole_cca
from pairlens.operators.moments import Layout, z_vector
from pairlens.plans import coupling, suite, wide

# One feature per view, the mean of its values: the SQL runs the same Newton iterations on (intercept, scaled feature).
_L11 = Layout(0, 1, 1)


def _z11():
    return z_vector(None, F.slice("h", 1, 1), F.slice("h", 2, 1))

def logistic_sql(feat: str) -> dict[str, str]:
    """Newton iterations for (intercept, two scaled features) per model m and fold f of `feat`.

    `feat` has m, f, subject_id, y, fold, x1, x2 for training and test rows alike; a
    representation with one feature has x2 = 0.
    """
    inv = {
        "i00": "h11*h22 - h12*h12", "i01": "h02*h12 - h01*h22", "i02": "h01*h12 - h02*h11",
        "i11": "h00*h22 - h02*h02", "i12": "h01*h02 - h00*h12", "i22": "h00*h11 - h01*h01",
    }
    steps = {"b0": "i00*g0 + i01*g1 + i02*g2", "b1": "i01*g0 + i11*g1 + i12*g2", "b2": "i02*g0 + i12*g1 + i22*g2"}
    return {
        "feat": feat,
        "ms": "SELECT m, f, avg(x1) AS m1, CASE WHEN min(x1) < max(x1) THEN stddev_pop(x1) ELSE 1 END AS s1, avg(x2) AS m2, CASE WHEN min(x2) < max(x2) THEN stddev_pop(x2) ELSE 1 END AS s2, "
        "count(*) / (2.0::DOUBLE * sum(1 - y)) AS w0, count(*) / (2.0::DOUBLE * sum(y)) AS w1 FROM feat WHERE fold <> f AND fold >= 0 GROUP BY m, f",
        "d": "SELECT feat.m AS m, feat.f AS f, y, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w FROM feat JOIN ms ON feat.m = ms.m AND feat.f = ms.f WHERE fold <> feat.f AND fold >= 0",
        "it": "SELECT 0 AS k, m, f, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM ms UNION ALL SELECT k + 1, m, f, "
        + ", ".join(f"{b} + ({e}) / (h00*i00 + h01*i01 + h02*i02)" for b, e in steps.items())
        + " FROM (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in inv.items()) + " FROM ("
        "SELECT k, m, f, b0, b1, b2, sum(w * (y - p)) AS g0, sum(w * (y - p) * z1) - b1 AS g1, sum(w * (y - p) * z2) - b2 AS g2, sum(w*p*(1-p)) AS h00, sum(w*p*(1-p)*z1) AS h01, sum(w*p*(1-p)*z2) AS h02, "
        "sum(w*p*(1-p)*z1*z1) + 1 AS h11, sum(w*p*(1-p)*z1*z2) AS h12, sum(w*p*(1-p)*z2*z2) + 1 AS h22 FROM "
        "(SELECT it.k AS k, it.m AS m, it.f AS f, it.b0 AS b0, it.b1 AS b1, it.b2 AS b2, d.w AS w, d.y AS y, d.z1 AS z1, d.z2 AS z2, 1 / (1 + exp(-(it.b0 + it.b1 * d.z1 + it.b2 * d.z2))) AS p "
        "FROM it JOIN d ON it.m = d.m AND it.f = d.f WHERE it.k < 12) GROUP BY k, m, f, b0, b1, b2))",
        "fin": "SELECT feat.m AS m, subject_id, y, fold, CASE WHEN fold = -1 THEN 'holdout' ELSE 'cv' END AS split, 1 / (1 + exp(-(b0 + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2))) AS score "
        "FROM feat JOIN ms ON feat.m = ms.m AND feat.f = ms.f JOIN it ON it.m = ms.m AND it.f = ms.f AND it.k = 12 WHERE fold = feat.f",
    }


_SPLIT_ONLY = {k: v for k, v in _SPLIT.items() if k != "tr"}
_ONE = logistic_sql("SELECT 'gene_only' AS m, f, subject_id, y, fold, h1 AS x1, 0.0::DOUBLE AS x2 FROM fo, folds")
_SUITE = logistic_sql(
    "SELECT m, f, subject_id, y, fold, CASE WHEN m = 'fmri_only' THEN h2 ELSE h1 END AS x1, CASE WHEN m IN ('gene_only', 'fmri_only') THEN 0.0::DOUBLE ELSE h2 END AS x2 FROM fo, folds, "
    "(VALUES ('gene_only'), ('fmri_only'), ('early_fusion'), ('cca_joint'), ('scca_joint')) AS t(m)"
)
_TWO_STAGE = cca22("tr", "f") | logistic_sql(
    "SELECT 'cca_joint' AS m, w.f AS f, subject_id, y, fold, a1*e1 + a2*e2 AS x1, b1*e3 + b2*e4 AS x2 FROM fo, w"
)


_STAGE_TWO = (
    {"rows0": "SELECT 0 AS k, * FROM fo"}
    | cca22("rows0", "k", prefix="g")
    | {"uv": "SELECT subject_id, y, fold, (a1*e1 + a2*e2) / stddev_pop(a1*e1 + a2*e2) OVER () AS u, (b1*e3 + b2*e4) / stddev_pop(b1*e3 + b2*e4) OVER () AS v FROM fo, gw"}
    | logistic_sql(
        "SELECT m, f, subject_id, y, fold, CASE m WHEN 'fmri_only' THEN v WHEN 'joint_mean' THEN (u + v) / 2 ELSE u END AS x1, CASE WHEN m = 'joint' THEN v ELSE 0.0::DOUBLE END AS x2 FROM uv, folds, "
        "(VALUES ('gene_only'), ('fmri_only'), ('joint'), ('joint_mean')) AS t(m)"
    )
)


def _metrics_sql() -> str:
    auc = auc_sql("fin", "m, split", "score")
    ap = ap_sql("fin", "m, split", "score")
    return f"SELECT m || '_logreg' AS model, split, n, n_pos, {r6('auc')} AS auc, {r6('ap')} AS ap FROM ({auc}) JOIN (SELECT m, split, ap FROM ({ap})) USING (m, split)"


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@register("logreg_cv", _recursive(psql(f"SELECT subject_id, y, CAST(fold AS INTEGER) AS fold, {r6('score')} AS score, CAST(score > 0.5 AS INTEGER) AS yhat FROM fin", **_SPLIT_ONLY, **_ONE)))
def logreg_cv(spark, sf):
    """Out-of-fold and holdout probabilities of a class-balanced, L2-penalized logistic regression."""
    rows = coupling.assign_splits(pairs(spark, sf))
    got = suite.cross_validated_scores(rows, _z11(), _L11, ["gene_only"], ["logreg"])
    return round_columns(got.select("subject_id", "y", "fold", "score", "yhat"), "score")


@register(
    "stage_two_metrics",
    _recursive(
        psql(
            f"SELECT 'gene_only_logreg' AS model, {r6('avg(acc)')} AS accuracy_mean, {r6('avg(prec)')} AS precision_mean, {r6('avg(rec)')} AS recall_mean, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp FROM ("
            "SELECT fold, avg(CAST(y = h AS INTEGER)) AS acc, coalesce(count(*) FILTER (WHERE y = 1 AND h = 1) / CAST(nullif(count(*) FILTER (WHERE h = 1), 0) AS DOUBLE), 0) AS prec, "
            "coalesce(count(*) FILTER (WHERE y = 1 AND h = 1) / CAST(nullif(count(*) FILTER (WHERE y = 1), 0) AS DOUBLE), 0) AS rec, count(*) FILTER (WHERE y = 1 AND h = 1) AS tp, count(*) FILTER (WHERE y = 0 AND h = 1) AS fp FROM "
            "(SELECT *, CAST(score > 0.5 AS INTEGER) AS h FROM fin WHERE fold >= 0) GROUP BY fold)",
            **_SPLIT_ONLY,
            **_ONE,
        )
    ),
)
def stage_two_metrics(spark, sf):
    rows = coupling.assign_splits(pairs(spark, sf))
    scores = suite.cross_validated_scores(rows, _z11(), _L11, ["gene_only"], ["logreg"], holdout=False)
    got = suite.stage_two_metrics(scores).select("model", "accuracy_mean", "precision_mean", "recall_mean", "tp", "fp")
    return round_columns(got, "accuracy_mean", "precision_mean", "recall_mean")


@register("two_stage_cv", _recursive(psql(f"SELECT subject_id, y, CAST(fold AS INTEGER) AS fold, {r6('score')} AS score FROM fin", **_SPLIT, **_TWO_STAGE)))
def two_stage_cv(spark, sf):
    """Per fold: canonical variates fitted on the training folds, then a classifier on [u, v]."""
    rows = coupling.assign_splits(pairs(spark, sf))
    scores = suite.cross_validated_scores(rows, z_2x2(), L_2X2, ["cca_joint"], ["logreg"], k=1)
    return round_columns(scores.select("subject_id", "y", "fold", "score"), "score")


@register("stage_two_feature_sets", _recursive(psql(_metrics_sql(), **_SPLIT_ONLY, **_STAGE_TWO)))
def stage_two_feature_sets(spark, sf):
    """Variates fitted on all rows, then classifiers on each of the four feature sets."""
    from pairlens.operators.linear import canonical_fit, canonical_variates

    rows = coupling.assign_splits(pairs(spark, sf))
    _, fit = canonical_fit(rows, z_2x2(), L_2X2, 1)
    variates = canonical_variates(rows, z_2x2(), fit, ["subject_id", "y", "fold"])
    z = z_vector(None, F.col("u"), F.col("v"))
    got = suite.predictive_suite(variates, z, _L11, representations=("gene_only", "fmri_only", "joint", "joint_mean"))
    return round_columns(got, "auc", "ap")


@register(
    "two_stage_cv_full",
    psql("SELECT m AS model, count(*) AS n, true AS probabilities FROM pairs, (VALUES ('cca_joint_logreg'), ('scca_joint_logreg')) AS t(m) GROUP BY 1"),
)
def two_stage_cv_full(spark, sf):
    """Both stage-one methods on 32 x 32 features with three component pairs."""
    rows = coupling.assign_splits(pairs(spark, sf))
    scores = suite.cross_validated_scores(rows, z_full(), L_FULL, ["cca_joint", "scca_joint"], ["logreg"], k=3)
    return scores.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("probabilities"))


@register(
    "mlp_cv",
    psql(
        "SELECT 'early_fusion_mlp' AS model, CASE WHEN fold = -1 THEN 'holdout' ELSE 'cv' END AS split, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, true AS auc_in_range, true AS ap_in_range FROM fo GROUP BY 1, 2",
        **({k: v for k, v in _SPLIT.items() if k not in ("folds", "tr")} | {"fo": _SPLIT["fo"].replace("% 5", "% 3")}),
    ),
)
def mlp_cv(spark, sf):
    """Perceptrons of two hidden layers on all 64 values, every fold's and the holdout's trained together; tests/test_mlp.py holds steps and scores against NumPy."""
    rows = coupling.assign_splits(pairs(spark, sf), n_folds=3)
    scores = suite.cross_validated_scores(rows, z_full(), L_FULL, ["early_fusion"], ["mlp"], hidden=(16, 8), mlp_iter=25)
    got = suite.suite_metrics(scores)
    return got.select("model", "split", "n", "n_pos", F.col("auc").between(0, 1).alias("auc_in_range"), F.col("ap").between(0, 1).alias("ap_in_range"))


@register("predictive_suite", _recursive(psql(_metrics_sql(), **_SPLIT_ONLY, **_SUITE)))
def predictive_suite(spark, sf):
    """All five representations with logistic regression: pooled CV scores and the holdout.

    One feature per view, so canonical variates are the scaled features themselves and
    the SQL can refit every model.
    """
    rows = coupling.assign_splits(pairs(spark, sf))
    return round_columns(suite.predictive_suite(rows, _z11(), _L11, k=1), "auc", "ap")


@register(
    "predictive_suite_counts",
    psql(
        "SELECT m AS model, CASE WHEN fold = -1 THEN 'holdout' ELSE 'cv' END AS split, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM fo, "
        "(VALUES ('gene_only_logreg'), ('fmri_only_logreg'), ('early_fusion_logreg'), ('cca_joint_logreg'), ('scca_joint_logreg')) AS t(m) GROUP BY 1, 2",
        **{k: v for k, v in _SPLIT.items() if k not in ("folds", "tr")},
    ),
)
def predictive_suite_counts(spark, sf):
    """Every row is scored exactly once per model, whatever the preparation scope."""
    rows = coupling.assign_splits(pairs(spark, sf))
    got = suite.predictive_suite(rows, z_full(), L_FULL, pca_dim=4, k=3, scope="train")
    return got.select("model", "split", "n", "n_pos")


_DUAL_SUITE = whole_cca(_FOLD_PARTS) | logistic_sql("SELECT 'gene_only' AS m, f, subject_id, y, fold, t AS x1, 0.0::DOUBLE AS x2 FROM tu JOIN fo USING (subject_id)")


@register("dual_suite", _recursive(psql(f"SELECT subject_id, y, CAST(fold AS INTEGER) AS fold, split, 'gene_only_logreg' AS model, {r6('score')} AS score FROM fin", **_SPLIT_ONLY, **_DUAL_SUITE)))
def dual_suite(spark, sf):
    """Out-of-fold and holdout scores of a classifier on the leading component of the feature blocks, fitted anew for every fold from one pass."""
    rows = coupling.assign_splits(pairs(spark, sf))
    got = wide.wide_scores(gene_blocks(rows), rows.select("subject_id", "fold", "y", "c", "b"), 1, ["gene_only"])
    return round_columns(got.select("subject_id", "y", "fold", "split", "model", "score"), "score")


@register(
    "dual_suite_metrics",
    psql(
        "SELECT m AS model, CASE WHEN fold = -1 THEN 'holdout' ELSE 'cv' END AS split, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM fo, "
        "(VALUES ('gene_only_logreg'), ('fmri_only_logreg'), ('early_fusion_logreg'), ('cca_joint_logreg'), ('scca_joint_logreg')) AS t(m) GROUP BY 1, 2",
        **{k: v for k, v in _SPLIT.items() if k not in ("folds", "tr")},
    ),
)
def dual_suite_metrics(spark, sf):
    """All five representations of the blocks with the second view, each row scored once per model."""
    rows = coupling.assign_splits(pairs(spark, sf))
    return wide.wide_suite(gene_blocks(rows), rows.select("subject_id", "fold", "y", "c", "b"), 4, k=3).select("model", "split", "n", "n_pos")
