"""Result tables: summaries, verdicts and comparisons over grids of experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.stats import r_two_sided, t_two_sided
from pairlens.operators.ranking import argmax_rows


def config_grid(
    spark, methods: Sequence[str], dims: Sequence[int], c_values: Sequence[float], max_dim: int | None = None
) -> DataFrame:
    """All configurations in grid order; the plain method has one penalty pair, dims are capped and de-duplicated."""
    feasible = sorted({min(d, max_dim) if max_dim is not None else d for d in dims})
    rows = []
    for method in methods:
        for dim in feasible:
            pairs = [(1.0, 1.0)] if method == "cca" else [(a, b) for a in c_values for b in c_values]
            rows += [(len(rows) + i, method, dim, c1, c2) for i, (c1, c2) in enumerate(pairs)]
    return spark.createDataFrame(rows, "position int, method string, dim int, c1 double, c2 double")


def cv_summary(folds: DataFrame, keys: Sequence[str], train: str = "r_train", val: str = "r_val") -> DataFrame:
    """Mean and population sd over folds, and the overfitting gap."""
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg(train).alias("mean_train"),
        F.stddev_pop(train).alias("std_train"),
        F.avg(val).alias("mean_val"),
        F.stddev_pop(val).alias("std_val"),
        (F.avg(train) - F.avg(val)).alias("overfitting_gap"),
    )


def best_config(results: DataFrame, keys: Sequence[str], by: str = "mean_val", position: str = "position") -> DataFrame:
    """Best configuration per key; failed ones never win and the first wins a tie."""
    return argmax_rows(results, keys, by, position)


def top_configs(results: DataFrame, n: int, by: str = "mean_val", position: str = "position") -> DataFrame:
    return results.orderBy(F.col(by).desc(), position).limit(n)


def union_results(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def flatten_results(records: DataFrame) -> DataFrame:
    """One row per configuration from nested result records (see `config_gap_rows`)."""
    return records.select("source", F.explode("results").alias("r")).select("source", "r.*")


def config_gap_rows(records: DataFrame) -> DataFrame:
    """(config, cv mean and sd, overfitting gap, holdout, generalization gap) per nested result."""
    flat = flatten_results(records)
    return flat.select(
        "source",
        "config",
        F.col("cv.mean_val").alias("cv_mean"),
        F.col("cv.std_val").alias("cv_std"),
        (F.col("cv.mean_train") - F.col("cv.mean_val")).alias("overfitting_gap"),
        F.col("holdout.r").alias("holdout_r"),
        (F.col("holdout.r_train") - F.col("holdout.r")).alias("generalization_gap"),
    )


def best_auc_by_feature_set(results: DataFrame) -> DataFrame:
    """Per feature set: best AUC of each method and their difference, 0 where one is absent."""
    best = results.groupBy("feature_set").pivot("method", ["cca", "scca"]).agg(F.max("auc"))
    filled = best.na.fill(0.0, ["cca", "scca"])
    return filled.select(
        "feature_set", F.col("cca").alias("cca_auc"), F.col("scca").alias("scca_auc"), (F.col("scca") - F.col("cca")).alias("delta")
    )


def method_verdict(results: DataFrame, margin: float = 0.02) -> DataFrame:
    """Overall best of both methods with the verdict at +-margin."""
    best = results.agg(
        F.max(F.when(F.col("method") == "cca", F.col("auc"))).alias("cca_best"),
        F.max(F.when(F.col("method") == "scca", F.col("auc"))).alias("scca_best"),
    )
    delta = F.col("scca_best") - F.col("cca_best")
    verdict = F.when(delta > margin, "scca_wins").when(delta < -margin, "cca_wins").otherwise("similar")
    return best.select("cca_best", "scca_best", delta.alias("delta_best"), verdict.alias("conclusion"))


def interpret_modalities(results: DataFrame, margin: float = 0.02) -> DataFrame:
    """Which view carries the signal, from the best AUC per feature set."""

    def top(kind: str) -> Column:
        return F.max(F.when(F.col("feature_set") == kind, F.col("auc")))

    best = results.agg(top("joint").alias("joint_auc"), top("gene_only").alias("gene_auc"), top("fmri_only").alias("fmri_auc"))
    j, g, b = F.col("joint_auc"), F.col("gene_auc"), F.col("fmri_auc")
    text = (
        F.when(j > F.greatest(g, b) + margin, "joint_outperforms")
        .when(g > b + margin, "gene_dominates")
        .when(b > g + margin, "fmri_dominates")
        .otherwise("similar")
    )
    return best.withColumn("interpretation", text)


def multiple_testing(tests: DataFrame, alpha: float = 0.05, p: str = "p_value") -> DataFrame:
    """Bonferroni threshold, survival and the expected number of false positives."""
    n = tests.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return (
        tests.withColumn("n_tests", n)
        .withColumn("bonferroni", F.lit(alpha) / F.col("n_tests"))
        .withColumn("nominal", F.col(p) < alpha)
        .withColumn("survives", F.col(p) < F.col("bonferroni"))
        .withColumn("expected_false", F.lit(alpha) * F.col("n_tests"))
    )


def effect_interval(results: DataFrame, diff: str = "r_diff", null_std: str = "null_std", p: str = "p_value") -> DataFrame:
    """Effect with its 95 % band from the permutation null."""
    half = 1.96 * F.col(null_std)
    return results.withColumns(
        {"ci_low": F.col(diff) - half, "ci_high": F.col(diff) + half, "significant": F.coalesce(F.col(p) < 0.05, F.lit(False))}
    )


def significant_count(results: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """How many of the tests fall below alpha."""
    return results.agg(F.count_if(F.col(p) < alpha).alias("n_significant"), F.count(F.lit(1)).alias("n_tests"))


def effect_grid(results: DataFrame, modalities: Sequence[str], diff: str = "r_diff") -> DataFrame:
    """Model by modality grid in fixed column order; absent cells stay NULL."""
    return results.groupBy("model").pivot("modality", list(modalities)).agg(F.first(diff))


def perm_pvalue(null: DataFrame, observed: DataFrame, keys: Sequence[str], r: str = "r", obs: str = "r_obs") -> DataFrame:
    """One-sided p with the add-one rule: (count(null >= observed) + 1) / (B + 1)."""
    keys = list(keys)
    joined = null.join(observed, keys) if keys else null.withColumn(obs, observed.select(obs).scalar())
    return joined.groupBy(*keys).agg(
        F.max(obs).alias(obs),
        F.count(F.lit(1)).alias("n_perm"),
        ((F.count_if(F.col(r) >= F.col(obs)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )


def perm_pvalue_two_sided(null: DataFrame, observed: DataFrame, keys: Sequence[str], diff: str = "diff", obs: str = "obs_diff") -> DataFrame:
    """Two-sided p without add-one, with mean and sd of the null."""
    keys = list(keys)
    joined = null.join(observed, keys) if keys else null.withColumn(obs, observed.select(obs).scalar())
    return joined.groupBy(*keys).agg(
        F.max(obs).alias(obs),
        F.count(F.lit(1)).alias("n_perm"),
        F.avg(diff).alias("null_mean"),
        F.stddev_pop(diff).alias("null_std"),
        F.avg((F.abs(diff) >= F.abs(obs)).cast("int")).alias("p_value"),
    )


def fold_stability(folds: DataFrame, keys: Sequence[str], r: str = "r_val", sparsity: str | None = None, n_features: int | None = None) -> DataFrame:
    """Spread of the first component over folds with its stability band, and selected features."""
    sd = F.stddev_pop(r)
    aggs = [
        F.avg(r).alias("mean"),
        sd.alias("std"),
        F.min(r).alias("min"),
        F.max(r).alias("max"),
        F.when(sd < 0.05, "stable").when(sd < 0.10, "moderate").otherwise("unstable").alias("band"),
    ]
    if sparsity is not None:
        aggs.append(F.floor((1 - F.avg(sparsity)) * n_features).cast("long").alias("n_selected"))
    return folds.groupBy(*keys).agg(*aggs)


def suite_comparison(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best model and the fixed comparisons between representations and classifiers."""
    keys = list(keys)

    def auc(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("auc")))

    names = ["gene_only_logreg", "fmri_only_logreg", "early_fusion_logreg", "early_fusion_mlp", "cca_joint_logreg"]
    wide = results.groupBy(*keys).agg(
        F.max_by("model", F.struct("auc", "model")).alias("best_model"), F.max("auc").alias("best_auc"), *[auc(m).alias(m) for m in names]
    )
    g, b, f, mlp, c = (F.col(n) for n in names)
    single = F.greatest(g, b)
    gain, cca_gain, nonlinear = f - single, c - f, mlp - f
    return wide.select(
        *keys,
        "best_model",
        "best_auc",
        F.when(b > g, "fmri").otherwise("gene").alias("better_view"),
        F.abs(b - g).alias("view_difference"),
        (F.abs(b - g) / single * 100).alias("view_percent"),
        gain.alias("fusion_gain"),
        F.when(gain > 0.03, "substantial").when(gain > 0.01, "modest").otherwise("minimal").alias("fusion_band"),
        cca_gain.alias("cca_gain"),
        F.when(F.abs(cca_gain) < 0.01, "no_advantage").when(cca_gain > 0, "improves").otherwise("hurts").alias("cca_band"),
        nonlinear.alias("mlp_gain"),
        F.when(nonlinear > 0.02, "nonlinear").when(F.abs(nonlinear) < 0.01, "linear_sufficient").otherwise("may_overfit").alias("mlp_band"),
    )


def cv_vs_holdout(results: DataFrame) -> DataFrame:
    """CV and holdout AUC side by side per model, with the best of each marked."""
    wide = results.groupBy("model").pivot("split", ["cv", "holdout"]).agg(F.max("auc"))
    best = wide.agg(
        F.struct(F.max_by("model", F.struct("cv", "model")).alias("cv"), F.max_by("model", F.struct("holdout", "model")).alias("ho")).alias("b")
    )
    marked = wide.withColumn("_b", best.scalar())
    return marked.select(
        "model", F.col("cv").alias("cv_auc"), F.col("holdout").alias("holdout_auc"),
        (F.col("model") == F.col("_b.cv")).alias("best_cv"), (F.col("model") == F.col("_b.ho")).alias("best_holdout"),
    )


def paired_t(folds: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Paired t statistic of two metrics over folds: t, degrees of freedom, mean difference and two-sided p-value."""
    d = F.col(a) - F.col(b)
    sd, n = F.stddev_samp(d), F.count(d)
    stats = folds.groupBy(*keys).agg(
        F.avg(d).alias("mean_diff"), (n - 1).alias("df"), F.when(sd > 0, F.avg(d) / (sd / F.sqrt(n))).alias("t")
    )
    return stats.withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))


def pearson_test(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson r with its t statistic, degrees of freedom and two-sided p-value."""
    ok = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    r = F.when(ok, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))
    stats = df.groupBy(*keys).agg(r.alias("r"), (F.count(F.lit(1)) - 2).alias("df"))
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r"))))
    return stats.withColumns({"t": t, "p_value": r_two_sided(F.col("r"), F.col("df"))})


def component_test(variates: DataFrame) -> DataFrame:
    """Pearson test per component of a variates table."""
    pairs = variates.select(F.posexplode(F.arrays_zip(F.col("u").alias("a"), F.col("v").alias("b"))).alias("component", "ab"))
    flat = pairs.select("component", F.col("ab.a").alias("a"), F.col("ab.b").alias("b"))
    return pearson_test(flat, ["component"], "a", "b")


def summary_table(results: DataFrame, digits: int = 4, by: str = "r_diff") -> DataFrame:
    """Rounded table sorted by the group difference, largest first."""
    cols = [
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name)
        for f in results.schema.fields
    ]
    return results.select(*cols).orderBy(F.col(by).desc())


