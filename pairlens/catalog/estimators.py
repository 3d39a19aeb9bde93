"""Linear estimators on vectors and customer covariates.

Where two features per view are enough to exercise an operator, the SQL solves the
same problem in closed form (2 x 2 eigenvalues); wider fits are checked by properties.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.catalog.fixtures import r6, round_columns, sql
from pairlens.catalog.registry import register
from pairlens.session import scratch_path
from pairlens.operators import block_pca as bp
from pairlens.operators import linear, permutation, reports, solve
from pairlens.operators.moments import Layout, build_covariates, column_stats, moments, z_vector
from pairlens.plans import coupling, export, interpretable

# ---- the paired table -----------------------------------------------------------

_VECTOR = "CAST(embedding AS DOUBLE[])"
PAIRS_SQL = (
    f"SELECT subject_id, y, age / 1000 AS a, sex AS g, {_VECTOR} AS e, "
    + ", ".join(f"list_avg({_VECTOR}[{16 * i + 1}:{16 * i + 16}]) AS e{i + 1}" for i in range(4))
    + f", list_avg({_VECTOR}[1:32]) AS h1, list_avg({_VECTOR}[33:64]) AS h2 FROM emb JOIN cov USING (subject_id) WHERE valid"
)


def _means(column: str, width: int, parts: int):
    """Means of equal parts of a vector of `width` values."""
    size = width // parts
    return F.array(*[F.aggregate(F.slice(column, i * size + 1, size), F.lit(0.0), lambda s, v: s + v) / size for i in range(parts)])


def pairs(spark, sf):
    """Vectors with valid covariates: x = the first 32 values, b = the other 32; q = means of the quarters, h = means of the halves."""
    from pairlens.operators.align import attach_covariates

    e = fx.emb(spark, sf).select("subject_id", "y", F.col("embedding").cast("array<double>").alias("e"))
    return attach_covariates(e, fx.cov(spark, sf)).select(
        "subject_id", "y", build_covariates(F.col("age") / 1000, "sex").alias("c"), F.slice("e", 1, 32).alias("x"), F.slice("e", 33, 32).alias("b"), "e",
        _means("e", 64, 4).alias("q"), _means("e", 64, 2).alias("h"),
    )


L_FULL = Layout(2, 32, 32)
L_2X2 = Layout(0, 2, 2)


def z_full():
    return z_vector(F.col("c"), F.col("x"), F.col("b"))


def z_2x2():
    """Two features per view, the means of its halves, no covariates."""
    return z_vector(None, F.slice("q", 1, 2), F.slice("q", 3, 2))


def psql(body: str, **extra: str) -> str:
    return sql("emb cov", body, pairs=PAIRS_SQL, **extra)


_SPLIT = {
    "sizes": "SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM pairs GROUP BY y",
    "shares": "SELECT y, ceil(0.2 * total) * n / total AS share, ceil(0.2 * total) AS want FROM sizes",
    "quota": "SELECT y, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, y) <= want - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS q FROM shares",
    "fo": "SELECT p.*, CASE WHEN rn <= q THEN -1 ELSE CAST(rn - q - 1 AS BIGINT) % 5 END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(subject_id || '|42'), subject_id) AS rn FROM pairs) AS p JOIN quota USING (y)",
    "folds": "SELECT DISTINCT fold AS f FROM fo",
    "tr": "SELECT f, fo.* FROM fo JOIN folds ON fo.fold <> f AND fo.fold >= 0",
}

# ---- moments, residuals, scaling --------------------------------------------------


@register(
    "moments",
    "WITH z AS (SELECT vec_id % 4 AS grp, list_concat([1.0::DOUBLE], embedding) AS z FROM embeddings) "
    f"SELECT grp, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r6('sum(z[i + 1] * z[j + 1])')} AS s FROM z, range(65) AS a(i), range(65) AS b(j) WHERE i <= j GROUP BY 1, 2, 3",
)
def moments_query(spark, sf):
    e = fx.table(spark, sf, "embeddings").withColumn("grp", F.col("vec_id") % 4)
    return round_columns(moments(e, ["grp"], z_vector(None, F.col("embedding"))), "s")


@register(
    "column_stats",
    f"SELECT label, CAST(d - 1 AS INTEGER) AS feature, count(*) AS n, {r6('avg(CAST(embedding[d] AS DOUBLE))')} AS mean, {r6('stddev_pop(CAST(embedding[d] AS DOUBLE))')} AS sd FROM embeddings, range(1, 65) AS r(d) GROUP BY 1, 2",
)
def column_stats_query(spark, sf):
    mom = moments(fx.table(spark, sf, "embeddings"), ["label"], z_vector(None, F.col("embedding")))
    return round_columns(column_stats(mom, ["label"]), "mean", "sd")


def _resid_ctes(where: str) -> dict[str, str]:
    """Residuals of every vector value on [1, a, g] fitted on the split rows that satisfy `where`, by the two-regressor closed form."""
    return {k: _SPLIT[k] for k in ("sizes", "shares", "quota", "fo")} | {
        "v": "SELECT subject_id, fold, a, g, unnest(e) AS v, unnest(range(64)) AS feature FROM fo",
        "st": f"SELECT feature, covar_pop(a, a) AS saa, covar_pop(g, g) AS sgg, covar_pop(a, g) AS sag, avg(a) AS ma, avg(g) AS mg, covar_pop(a, v) AS sa, covar_pop(g, v) AS sg, avg(v) AS m FROM v WHERE {where} GROUP BY feature",
        "co": "SELECT *, (sa * sgg - sg * sag) / (saa * sgg - sag * sag) AS ba, (sg * saa - sa * sag) / (saa * sgg - sag * sag) AS bg FROM st",
        "res": "SELECT subject_id, fold, feature, v, v - m - ba * (a - ma) - bg * (g - mg) AS r FROM v JOIN co USING (feature)",
        "sc": f"SELECT feature, avg(r) AS mean, stddev_pop(r) AS sd FROM res WHERE {where} GROUP BY feature",
    }


_TRAIN = "fold >= 0"
_RESID = f"SELECT subject_id, CAST(feature AS INTEGER) AS feature, {r6('r')} AS value FROM res"
_SCALED = f"SELECT subject_id, CAST(feature AS INTEGER) AS feature, {r6('(r - mean) / sd')} AS value FROM res JOIN sc USING (feature)"


def _long(df):
    """A row per subject and value of both prepared views."""
    return round_columns(df.select("subject_id", F.posexplode(F.concat("x", "y")).alias("feature", "value")), "value")


@register("residualize", psql(_RESID, **_resid_ctes("true")))
def residualize(spark, sf):
    return _long(linear.prepare_views(pairs(spark, sf), z_full(), L_FULL, ["subject_id"], standardize=False))


@register("residualize_train", psql(_RESID, **_resid_ctes(_TRAIN)))
def residualize_train(spark, sf):
    rows = coupling.assign_splits(pairs(spark, sf))
    return _long(linear.prepare_views(rows, z_full(), L_FULL, ["subject_id"], F.col("fold") >= 0, standardize=False))


@register("standardize_train", psql(_SCALED, **_resid_ctes(_TRAIN)))
def standardize_train(spark, sf):
    rows = coupling.assign_splits(pairs(spark, sf))
    return _long(linear.prepare_views(rows, z_full(), L_FULL, ["subject_id"], F.col("fold") >= 0))


@register(
    "feature_prep_export",
    psql(
        f"SELECT subject_id, CAST(feature AS INTEGER) AS feature, {r6('v')} AS raw, {r6('r')} AS resid, {r6('(r - mean) / sd')} AS z FROM res JOIN sc USING (feature)",
        **_resid_ctes("true"),
    ),
)
def feature_prep_export(spark, sf):
    """Raw, residualized and scaled views of the aligned subjects from one moment pass and one map."""
    df = pairs(spark, sf)
    m = linear.moment_matrix(df, z_full())
    eye = np.eye(L_FULL.dim)[:, L_FULL.x.start :]
    maps = {"raw": eye, "resid": solve.linear_prep(m, L_FULL, standardize=False), "z": solve.linear_prep(m, L_FULL)}
    got = linear.project(df, z_full(), maps, ["subject_id"])
    long = got.select("subject_id", F.posexplode(F.arrays_zip(*maps)).alias("feature", "v")).select("subject_id", "feature", *[F.col(f"v.{c}").alias(c) for c in maps])
    return round_columns(long, *maps)


# ---- PCA ----------------------------------------------------------------------------


@register(
    "pca_scores",
    psql(
        f"SELECT subject_id, {r6('abs(z1 + sign(r) * z2) / sqrt(2)')} AS pc1_abs, {r6('abs(z1 - sign(r) * z2) / sqrt(2)')} AS pc2_abs FROM "
        "(SELECT subject_id, (h1 - m1) / s1 AS z1, (h2 - m2) / s2 AS z2, r FROM pairs, (SELECT avg(h1) AS m1, avg(h2) AS m2, stddev_pop(h1) AS s1, stddev_pop(h2) AS s2, corr(h1, h2) AS r FROM pairs))",
    ),
)
def pca_scores(spark, sf):
    """Two standardized features have the components (1, +-1)/sqrt(2)."""
    z, layout = z_vector(None, F.col("h")), Layout(0, 2, 0)
    got, _, _ = linear.pca_scores(pairs(spark, sf), z, layout, 2, ["subject_id"], residualize=True)
    return round_columns(got.select("subject_id", *[F.abs(F.col("pcs")[i]).alias(f"pc{i + 1}_abs") for i in range(2)]), "pc1_abs", "pc2_abs")


_POWER = (
    "WITH RECURSIVE g AS (SELECT i, j, covar_pop(CAST(embedding[i] AS DOUBLE), CAST(embedding[j] AS DOUBLE)) / (stddev_pop(CAST(embedding[i] AS DOUBLE)) * stddev_pop(CAST(embedding[j] AS DOUBLE))) AS v FROM embeddings, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY 1, 2), "
    "m AS (SELECT list(v ORDER BY j) AS row, i FROM g GROUP BY i), mat AS (SELECT list(row ORDER BY i) AS a FROM m), "
    "it AS (SELECT 0 AS k, [cos(i * i)::DOUBLE for i in range(1, 65)] AS v UNION ALL SELECT k + 1, [x / sqrt(list_dot_product(w, w)) for x in w] FROM (SELECT k, [list_dot_product(r, v) for r in a] AS w FROM it, mat WHERE k < 3000)) "
)


@register(
    "pca_top_eigenvalue",
    _POWER + "SELECT CAST(64 AS INTEGER) AS n_components, " + r6("list_dot_product(v, [list_dot_product(r, v) for r in a])") + " AS top, 64.0::DOUBLE AS total FROM it, mat WHERE k = 3000",
)
def pca_top_eigenvalue(spark, sf):
    """Largest eigenvalue of all standardized features; the SQL finds it by power iteration."""
    z, layout = z_vector(None, F.col("embedding")), Layout(0, 64, 0)
    e = fx.emb(spark, sf)
    m = linear.moment_matrix(e, z)
    cov = solve.covariance(m, solve.linear_prep(m, layout))[2]
    values, _ = solve.pca(cov, 64)
    row = [(len(values), float(values[0]), float(np.round(values.sum(), 9)))]
    return round_columns(spark.createDataFrame(row, "n_components int, top double, total double"), "top", "total")


@register(
    "pca_properties",
    psql("SELECT count(*) AS n, CAST(6 AS BIGINT) AS components, true AS centred, true AS uncorrelated, true AS variances_match FROM pairs"),
)
def pca_properties(spark, sf):
    """Scores are centred, uncorrelated and have the eigenvalues as variances."""
    got, values, _ = linear.pca_scores(pairs(spark, sf), z_full(), L_FULL, 6, ["subject_id"], residualize=True)
    cells = moments(got, [], z_vector(None, F.col("pcs")))
    n = got.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    lam = F.array(F.lit(1.0), *[F.lit(float(v)) for v in values])
    off = F.col("i") < F.col("j")
    return cells.withColumn("n", n).groupBy("n").agg(
        F.lit(len(values)).cast("long").alias("components"),
        F.bool_and(~((F.col("i") == 0) & off) | (F.abs(F.col("s") / F.col("n")) < 1e-9)).alias("centred"),
        F.bool_and(~(off & (F.col("i") > 0)) | (F.abs(F.col("s") / F.col("n")) < 1e-9)).alias("uncorrelated"),
        F.bool_and(off | (F.col("i") == 0) | (F.abs(F.col("s") / F.col("n") - F.get(lam, F.col("i"))) < 1e-9)).alias("variances_match"),
    )


@register(
    "block_pca",
    sql("emb", "SELECT CAST(c AS INTEGER) AS pc, true AS eigenvalue_matches, true AS total_matches, (SELECT count(*) FROM emb) AS n_scores FROM range(4) AS r(c)"),
)
def block_pca(spark, sf):
    """Block-wise PCA of eight gene blocks against the exact PCA of the 64 concatenated features."""
    model, scores = bp.block_pca(fx.blocks(spark, sf), k=4, oversample=60)
    e = fx.emb(spark, sf)
    z, layout = z_vector(None, F.col("embedding")), Layout(0, 64, 0)
    m = linear.moment_matrix(e, z)
    exact, _ = solve.pca(solve.covariance(m, solve.linear_prep(m, layout))[2], 4)
    rows = [(i, bool(abs(a - b) < 1e-6 * b), bool(abs(model.total_variance - 64) < 1e-6)) for i, (a, b) in enumerate(zip(model.eigenvalues, exact))]
    n = scores.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return spark.createDataFrame(rows, "pc int, eigenvalue_matches boolean, total_matches boolean").withColumn("n_scores", n)


@register(
    "explained_variance",
    _POWER + "SELECT CAST(1 AS INTEGER) AS n_components, " + r6("list_dot_product(v, [list_dot_product(r, v) for r in a]) / 64") + " AS explained FROM it, mat WHERE k = 3000",
)
def explained_variance(spark, sf):
    z, layout = z_vector(None, F.col("embedding")), Layout(0, 64, 0)
    _, values, total = linear.pca_scores(fx.emb(spark, sf), z, layout, 1, ["subject_id"], residualize=True)
    n, share = linear.explained_variance(values, total)
    return round_columns(spark.createDataFrame([(n, share)], "n_components int, explained double"), "explained")


# ---- canonical correlation ----------------------------------------------------------


def cca22(rows: str, key: str, x=("e1", "e2"), y=("e3", "e4"), prefix: str = "") -> dict[str, str]:
    """Closed-form CCA of two features per view for every key of `rows`."""
    (x1, x2), (y1, y2) = x, y
    st = {"a11": (x1, x1), "a12": (x1, x2), "a22": (x2, x2), "b11": (y1, y1), "b12": (y1, y2), "b22": (y2, y2),
          "c11": (x1, y1), "c12": (x1, y2), "c21": (x2, y1), "c22": (x2, y2)}
    moments_ = ", ".join(f"covar_pop({u}, {v}) AS {n}" for n, (u, v) in st.items())
    return {
        f"{prefix}st": f"SELECT {key}, {moments_} FROM {rows} GROUP BY {key}",
        f"{prefix}pq": f"SELECT {key}, (a22*c11 - a12*c21)/(a11*a22-a12*a12) AS p11, (a22*c12 - a12*c22)/(a11*a22-a12*a12) AS p12, (a11*c21 - a12*c11)/(a11*a22-a12*a12) AS p21, (a11*c22 - a12*c12)/(a11*a22-a12*a12) AS p22, "
        f"(b22*c11 - b12*c12)/(b11*b22-b12*b12) AS q11, (b22*c21 - b12*c22)/(b11*b22-b12*b12) AS q12, (b11*c12 - b12*c11)/(b11*b22-b12*b12) AS q21, (b11*c22 - b12*c21)/(b11*b22-b12*b12) AS q22 FROM {prefix}st",
        f"{prefix}mm": f"SELECT *, p11*q11+p12*q21 AS m11, p11*q12+p12*q22 AS m12, p21*q11+p22*q21 AS m21, p21*q12+p22*q22 AS m22 FROM {prefix}pq",
        f"{prefix}ev": f"SELECT *, ((m11+m22) + sqrt((m11-m22)*(m11-m22) + 4*m12*m21))/2 AS l1, ((m11+m22) - sqrt((m11-m22)*(m11-m22) + 4*m12*m21))/2 AS l2 FROM {prefix}mm",
        f"{prefix}w": f"SELECT {key}, sqrt(l1) AS r1, sqrt(greatest(l2, 0)) AS r2, m12 AS a1, l1 - m11 AS a2, q11*m12 + q12*(l1-m11) AS b1, q21*m12 + q22*(l1-m11) AS b2 FROM {prefix}ev",
    }


_ALL = {"rows": "SELECT 0 AS k, * FROM pairs"}


@register("cca_2x2", psql(f"SELECT CAST(component AS INTEGER) AS component, {r6('r')} AS r FROM (SELECT 0 AS component, r1 AS r FROM w UNION ALL SELECT 1, r2 FROM w)", **_ALL, **cca22("rows", "k")))
def cca_2x2(spark, sf):
    _, fit = linear.canonical_fit(pairs(spark, sf), z_2x2(), L_2X2, 2)
    return round_columns(spark.createDataFrame([(i, float(r)) for i, r in enumerate(fit.r_train)], "component int, r double"), "r")


@register(
    "cca_variates",
    psql(
        f"SELECT subject_id, {r6('abs((u - avg(u) OVER ()) / stddev_pop(u) OVER ())')} AS u_abs, {r6('abs((v - avg(v) OVER ()) / stddev_pop(v) OVER ())')} AS v_abs FROM (SELECT subject_id, a1*e1 + a2*e2 AS u, b1*e3 + b2*e4 AS v FROM rows, w)",
        **_ALL, **cca22("rows", "k"),
    ),
)
def cca_variates(spark, sf):
    df = pairs(spark, sf)
    _, fit = linear.canonical_fit(df, z_2x2(), L_2X2, 1)
    got = linear.canonical_variates(df, z_2x2(), fit, ["subject_id"])
    return round_columns(got.select("subject_id", F.abs(F.col("u")[0]).alias("u_abs"), F.abs(F.col("v")[0]).alias("v_abs")), "u_abs", "v_abs")


_COMPONENT = "SELECT y, c, CAST(embedding[c + 1] AS DOUBLE) AS u, CAST(embedding[c + 33] AS DOUBLE) AS v FROM emb, range(32) AS x(c)"


@register("canonical_corr", sql("emb", f"SELECT y, CAST(c AS INTEGER) AS component, count(*) AS n, {r6('corr(u, v)')} AS r FROM ({_COMPONENT}) GROUP BY y, c"))
def canonical_corr(spark, sf):
    e = fx.emb(spark, sf).select("y", F.col("embedding").cast("array<double>").alias("e"))
    got = linear.variate_correlations(e.select("y", F.slice("e", 1, 32).alias("u"), F.slice("e", 33, 32).alias("v")), ["y"])
    return round_columns(got, "r")


@register(
    "component_test",
    sql(
        "emb",
        f"SELECT CAST(c AS INTEGER) AS component, {r6('r')} AS r, df, {r6('t')} AS t, {r6('p')} AS p_value FROM ({fx.t_p_value_sql('tests', 'c, r, df, t')})",
        tests=f"SELECT c, r, df, r * sqrt(df / (1 - r * r)) AS t FROM (SELECT c, corr(u, v) AS r, count(*) - 2 AS df FROM ({_COMPONENT}) GROUP BY c)",
    ),
)
def component_test(spark, sf):
    e = fx.emb(spark, sf).select(F.col("embedding").cast("array<double>").alias("e"))
    return round_columns(reports.component_test(e.select(F.slice("e", 1, 32).alias("u"), F.slice("e", 33, 32).alias("v"))), "r", "t", "p_value")


@register(
    "cca_properties",
    psql("SELECT CAST(c AS INTEGER) AS component, true AS unit_variance, true AS reproduces_r, true AS decreasing FROM range(32) AS r(c)"),
)
def cca_properties(spark, sf):
    """32 x 32 features after covariate removal: unit variates whose row-wise correlations equal the fit."""
    df = pairs(spark, sf)
    _, fit = linear.canonical_fit(df, z_full(), L_FULL, 32)
    got = linear.variate_correlations(linear.canonical_variates(df, z_full(), fit, ["subject_id"]))
    sd = linear.canonical_variates(df, z_full(), fit, ["subject_id"]).select(F.posexplode("u").alias("component", "a")).groupBy("component").agg(F.stddev_pop("a").alias("sd"))
    expected = F.array(*[F.lit(float(r)) for r in fit.r_train])
    below = F.get(F.array(*[F.lit(bool(i == 0 or fit.r_train[i] <= fit.r_train[i - 1])) for i in range(32)]), F.col("component"))
    return got.join(sd, "component").select(
        "component", (F.abs(F.col("sd") - 1) < 1e-9).alias("unit_variance"), (F.abs(F.col("r") - F.get(expected, F.col("component"))) < 1e-9).alias("reproduces_r"), below.alias("decreasing")
    )


_LOAD = psql(
    f"SELECT CAST(f AS INTEGER) AS feature, {r6('abs(r)')} AS loading_abs, {r6('abs(r) * n / (n - 1)')} AS inflated_abs FROM ("
    "SELECT 0 AS f, corr(e1, a1*e1 + a2*e2) AS r, CAST(count(*) AS DOUBLE) AS n FROM rows, w UNION ALL SELECT 1, corr(e2, a1*e1 + a2*e2), CAST(count(*) AS DOUBLE) FROM rows, w)",
    **_ALL, **cca22("rows", "k"),
)


@register("loadings", _LOAD)
def loadings(spark, sf):
    model, fit = linear.canonical_fit(pairs(spark, sf), z_2x2(), L_2X2, 1)
    plain = solve.loadings(model.cov[:2, :2], fit.a, model.n)[:, 0]
    inflated = solve.loadings(model.cov[:2, :2], fit.a, model.n, inflate=True)[:, 0]
    rows = [(i, float(abs(a)), float(abs(b))) for i, (a, b) in enumerate(zip(plain, inflated))]
    return round_columns(spark.createDataFrame(rows, "feature int, loading_abs double, inflated_abs double"), "loading_abs", "inflated_abs")


# Correlation matrix of two standardized features per view and its leading singular pair.
_SVD22 = {
    "s": "SELECT corr(e1, e3) AS c11, corr(e1, e4) AS c12, corr(e2, e3) AS c21, corr(e2, e4) AS c22, corr(e1, e2) AS rx, corr(e3, e4) AS ry FROM pairs",
    "t": "SELECT *, c11*c11 + c12*c12 AS k11, c11*c21 + c12*c22 AS k12, c21*c21 + c22*c22 AS k22 FROM s",
    "u": "SELECT *, ((k11+k22) + sqrt((k11-k22)*(k11-k22) + 4*k12*k12))/2 AS l FROM t",
    "v": "SELECT *, k12 / sqrt(k12*k12 + (l-k11)*(l-k11)) AS u1, (l - k11) / sqrt(k12*k12 + (l-k11)*(l-k11)) AS u2 FROM u",
    "x": "SELECT *, (c11*u1 + c21*u2) / sqrt(l) AS v1, (c12*u1 + c22*u2) / sqrt(l) AS v2 FROM v",
}


@register(
    "scca_2x2",
    psql(f"SELECT {r6('sqrt(l) / sqrt((1 + 2*rx*u1*u2) * (1 + 2*ry*v1*v2))')} AS r, {r6('greatest(abs(u1), abs(u2))')} AS top_x, {r6('greatest(abs(v1), abs(v2))')} AS top_y FROM x", **_SVD22),
)
def scca_2x2(spark, sf):
    """Without a binding L1 bound the sparse solution is the leading singular pair."""
    _, fit = linear.canonical_fit(pairs(spark, sf), z_2x2(), L_2X2, 1, method="scca", c1=1.0, c2=1.0)
    row = [(float(fit.r_train[0]), float(np.abs(fit.a).max()), float(np.abs(fit.b).max()))]
    return round_columns(spark.createDataFrame(row, "r double, top_x double, top_y double"), "r", "top_x", "top_y")


def _scca_rows(spark, sf, **options):
    model, fit = linear.canonical_fit(pairs(spark, sf), z_full(), L_FULL, 2, method="scca", c1=0.3, c2=0.3, **options)
    out = []
    for c in range(2):
        for view, w, p in (("x", fit.a, 32), ("y", fit.b, 32)):
            unit = abs(np.linalg.norm(w[:, c]) - 1) < 1e-9
            within = np.abs(w[:, c]).sum() <= solve.l1_bound(0.3, p, options.get("bound", "interpolate")) + 1e-6
            out.append((c, view, bool(unit), bool(within)))
    return spark.createDataFrame(out, "component int, view string, unit_norm boolean, within_bound boolean")


_SCCA_SQL = "SELECT CAST(c AS INTEGER) AS component, v AS view, true AS unit_norm, true AS within_bound FROM range(2) AS r(c), (VALUES ('x'), ('y')) AS t(v)"


@register("scca", psql(_SCCA_SQL))
def scca(spark, sf):
    """Sparse weights with the bound on the unit vector (the published form)."""
    return _scca_rows(spark, sf, projection="paper")


@register("scca_raw", psql("SELECT CAST(c AS INTEGER) AS component, v AS view, true AS unit_norm FROM range(2) AS r(c), (VALUES ('x'), ('y')) AS t(v)"))
def scca_raw(spark, sf):
    """Bound on the covariance vector as it comes; only the unit length is guaranteed."""
    return _scca_rows(spark, sf).select("component", "view", "unit_norm")


@register("scca_fraction", psql("SELECT CAST(c AS INTEGER) AS component, v AS view, true AS unit_norm FROM range(2) AS r(c), (VALUES ('x'), ('y')) AS t(v)"))
def scca_fraction(spark, sf):
    return _scca_rows(spark, sf, bound="fraction").select("component", "view", "unit_norm")


# ---- permutation tests -------------------------------------------------------------


@register(
    "permutation_test_rows",
    psql(
        f"SELECT CAST(component AS INTEGER) AS component, {r6('r')} AS r_obs, CAST(200 AS BIGINT) AS n_perm, true AS p_in_range FROM (SELECT 0 AS component, r1 AS r FROM w UNION ALL SELECT 1, r2 FROM w)",
        **_ALL, **cca22("rows", "k"),
    ),
)
def permutation_test_rows(spark, sf):
    observed, null = permutation.permutation_null_rows(pairs(spark, sf), z_2x2(), L_2X2, n_perm=200, k=2)
    obs = spark.createDataFrame([(i, float(r)) for i, r in enumerate(observed)], "component int, r_obs double")
    got = reports.perm_pvalue(null, obs, ["component"])
    ok = (F.col("p_value") >= 1 / 201) & (F.col("p_value") <= 1)
    return round_columns(got.select("component", "r_obs", "n_perm", ok.alias("p_in_range")), "r_obs")


@register(
    "permutation_test_groups",
    psql("SELECT CAST(100 AS BIGINT) AS n_perm, true AS p_in_range, true AS null_centred FROM pairs LIMIT 1"),
)
def permutation_test_groups(spark, sf):
    """Label permutations refit both groups; 40 of the 100 come from an earlier, resumed run."""
    df = pairs(spark, sf)
    done = permutation.permutation_null_groups(df, z_full(), L_FULL, 40, "cca", 4)
    null = permutation.permutation_null_groups(df, z_full(), L_FULL, 100, "cca", 4, completed=done)
    obs = spark.createDataFrame([(0.1,)], "obs_diff double")
    got = reports.perm_pvalue_two_sided(null, obs, [])
    return got.select("n_perm", F.col("p_value").between(0, 1).alias("p_in_range"), (F.abs("null_mean") < 0.2).alias("null_centred"))


# ---- grids ---------------------------------------------------------------------------

_GRID_TAIL = {
    "rt": "SELECT f, r1 AS r_train FROM w",
    "rv": "SELECT f, corr(a1*e1 + a2*e2, b1*e3 + b2*e4) AS r_eval FROM fo JOIN w ON fo.fold = w.f GROUP BY f",
    "sc": "SELECT * FROM rt JOIN rv USING (f)",
}


@register(
    "assign_splits",
    psql("SELECT subject_id, y, CAST(fold AS INTEGER) AS fold FROM fo", **{k: v for k, v in _SPLIT.items() if k not in ("folds", "tr")}),
)
def assign_splits(spark, sf):
    return coupling.assign_splits(pairs(spark, sf).select("subject_id", "y")).select("subject_id", "y", "fold")


_GRID_SQL = psql(
    f"SELECT 'cca_pca2' AS config, {r6('avg(r_train) FILTER (WHERE f >= 0)')} AS mean_train, {r6('avg(r_eval) FILTER (WHERE f >= 0)')} AS mean_val, {r6('stddev_pop(r_eval) FILTER (WHERE f >= 0)')} AS std_val, "
    f"{r6('max(r_train) FILTER (WHERE f = -1)')} AS r_train_final, {r6('max(r_eval) FILTER (WHERE f = -1)')} AS r_holdout FROM sc",
    **_SPLIT, **cca22("tr", "f"), **_GRID_TAIL,
)
_GRID_COLS = ["mean_train", "mean_val", "std_val", "r_train_final", "r_holdout"]


@register("coupling_grid", _GRID_SQL)
def coupling_grid(spark, sf):
    """Cross-validated CCA of two features per view with holdout; the SQL refits every fold in closed form."""
    grid = reports.config_grid(spark, ["cca"], [2], [])
    rows = coupling.assign_splits(pairs(spark, sf))
    got = coupling.coupling_grid(rows, z_2x2(), L_2X2, grid, n_components=1)
    return round_columns(got.select("config", *_GRID_COLS), *_GRID_COLS)


@register("coupling_grid_wide", _GRID_SQL)
def coupling_grid_wide(spark, sf):
    """The same grid with view x kept as feature blocks and PCA refitted per fold."""
    rows = coupling.assign_splits(pairs(spark, sf)).select(
        "subject_id", "fold", F.array().cast("array<double>").alias("c"), F.slice("q", 3, 2).alias("b"), "q"
    )
    parts = F.array(*[F.struct(F.lit(f"g{i}").alias("gene"), F.slice("q", i + 1, 1).alias("embedding")) for i in range(2)])
    grid = reports.config_grid(spark, ["cca"], [2], [])
    got = coupling.wide_coupling_grid(rows.select("subject_id", F.inline(parts)), rows.drop("q"), 0, 2, grid, n_components=1)
    return round_columns(got.select("config", *_GRID_COLS), *_GRID_COLS)


_WIDE_DIMS = [2, 4, 8]


@register(
    "coupling_grid_full",
    psql(
        "SELECT config, true AS finished, CAST(5 AS BIGINT) AS n_folds, (SELECT count(*) FROM fo WHERE fold >= 0) AS n_train, (SELECT count(*) FROM fo WHERE fold = -1) AS n_holdout FROM ("
        "SELECT 'cca_pca' || d AS config FROM (VALUES (2), (4), (8)) AS v(d) UNION ALL SELECT 'scca_pca' || d || '_c' || a || '_' || b FROM (VALUES (2), (4), (8)) AS v(d), (VALUES ('0.1'), ('0.5')) AS x(a), (VALUES ('0.1'), ('0.5')) AS y(b))",
        **_SPLIT,
    ),
)
def coupling_grid_full(spark, sf):
    """The whole grid on 32 x 32 features with covariates, every configuration finished."""
    grid = reports.config_grid(spark, ["cca", "scca"], _WIDE_DIMS, [0.1, 0.5], 32)
    rows = coupling.assign_splits(pairs(spark, sf))
    got = coupling.run_grid(coupling.split_moments(rows, z_full()), L_FULL, grid)
    hold = F.col("fold") == coupling.HOLDOUT
    return got.groupBy("config").agg(
        F.bool_and(F.col("error").isNull() & F.col("r_eval").between(-1, 1) & F.col("r_train").between(0, 1)).alias("finished"),
        F.count_if(~hold).alias("n_folds"), F.max(F.when(hold, F.col("n_train"))).alias("n_train"), F.max(F.when(hold, F.col("n_eval"))).alias("n_holdout"),
    )


@register(
    "coupling_grid_extra",
    psql("SELECT 'cca_pca4' AS config, true AS finished, true AS covariates_removed FROM pairs LIMIT 1"),
)
def coupling_grid_extra(spark, sf):
    """A nuisance covariate beyond age and sex: the first x feature, which then carries nothing."""
    rows = coupling.assign_splits(pairs(spark, sf).withColumn("c", F.concat("c", F.slice("x", 1, 1))))
    layout = Layout(3, 32, 32)
    z = z_vector(F.col("c"), F.col("x"), F.col("b"))
    grid = reports.config_grid(spark, ["cca"], [4], [], 32)
    got = coupling.coupling_grid(rows, z, layout, grid, n_components=2)
    prepared = linear.prepare_views(rows, z, layout, ["subject_id"], standardize=False)
    gone = prepared.agg((F.max(F.abs(F.col("x")[0])) < 1e-6).alias("g")).select("g").scalar()
    return got.select("config", F.col("error").isNull().alias("finished"), gone.alias("covariates_removed"))


_GROUP_SPLIT = {
    "fo": "SELECT *, CASE WHEN rn <= ceil(0.2 * n) THEN -1 ELSE CAST(rn - ceil(0.2 * n) - 1 AS BIGINT) % 5 END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(subject_id || '|42'), subject_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM pairs)",
    "tr": "SELECT * FROM fo WHERE fold >= 0",
}


@register(
    "stratified_coupling",
    psql(
        f"SELECT 'cca_pca2' AS case_config, 'cca_pca2' AS control_config, {r6('max(r) FILTER (WHERE y = 1)')} AS r_case, {r6('max(r) FILTER (WHERE y = 0)')} AS r_control, {r6('max(r) FILTER (WHERE y = 1) - max(r) FILTER (WHERE y = 0)')} AS r_diff FROM rv",
        **_GROUP_SPLIT, **cca22("tr", "y"),
        rv="SELECT fo.y AS y, corr(a1*e1 + a2*e2, b1*e3 + b2*e4) AS r FROM fo JOIN w ON fo.y = w.y WHERE fold = -1 GROUP BY fo.y",
    ),
)
def stratified_coupling(spark, sf):
    """Coupling per label group and its difference; each group is split on its own."""
    from pairlens.operators.splits import split_by_label

    rows = coupling.assign_splits(split_by_label(pairs(spark, sf)), group="grp")
    got = coupling.stratified_coupling(rows, z_2x2(), L_2X2, reports.config_grid(spark, ["cca"], [2], []), n_components=1)
    cols = ["r_case", "r_control", "r_diff"]
    return round_columns(got.select("case_config", "control_config", *cols), *cols)


@register(
    "stratified_coupling_cached",
    psql(
        f"SELECT 'cca_pca2' AS case_config, 'cca_pca2' AS control_config, {r6('max(r) FILTER (WHERE y = 1)')} AS r_case, {r6('max(r) FILTER (WHERE y = 0)')} AS r_control, {r6('max(r) FILTER (WHERE y = 1) - max(r) FILTER (WHERE y = 0)')} AS r_diff FROM rv",
        **_GROUP_SPLIT, **cca22("tr", "y"),
        rv="SELECT fo.y AS y, corr(a1*e1 + a2*e2, b1*e3 + b2*e4) AS r FROM fo JOIN w ON fo.y = w.y WHERE fold = -1 GROUP BY fo.y",
    ),
)
def stratified_coupling_cached(spark, sf):
    """The same from fold moments written once: the second call gets no rows at all."""
    from pairlens.operators.splits import split_by_label

    rows = coupling.assign_splits(split_by_label(pairs(spark, sf)), group="grp")
    path, grid = scratch_path(spark, "group-moments"), reports.config_grid(spark, ["cca"], [2], [])
    coupling.materialize_moments(coupling.split_moments(rows, z_2x2(), ["grp"]), path, ["grp"])
    got = coupling.stratified_coupling(rows.limit(0), z_2x2(), L_2X2, grid, n_components=1, cache_path=path)
    cols = ["r_case", "r_control", "r_diff"]
    return round_columns(got.select("case_config", "control_config", *cols), *cols)


# ---- whole views: all 32 x 32 values with covariates ----------------------------------
# The queries above keep two features per view, which SQL can refit; these fit everything and their values are held against NumPy in the tests.

WHOLE_DIMS = [2, 8, 32]


def whole_grid(spark, sf):
    """Cross-validated CCA and SCCA of all 32 x 32 values, age and sex removed per fold, with holdout; one row per configuration."""
    grid = reports.config_grid(spark, ["cca", "scca"], WHOLE_DIMS, [0.3], 32)
    return coupling.coupling_grid(coupling.assign_splits(pairs(spark, sf)), z_full(), L_FULL, grid)


def whole_grid_wide(spark, sf):
    """The CCA grid with the first 32 values as four gene blocks of 8, the other 32 as the second view."""
    rows = coupling.assign_splits(pairs(spark, sf))
    parts = F.array(*[F.struct(F.lit(f"g{i}").alias("gene"), F.slice("x", 8 * i + 1, 8).alias("embedding")) for i in range(4)])
    grid = reports.config_grid(spark, ["cca"], [2, 8], [])
    return coupling.wide_coupling_grid(rows.select("subject_id", F.inline(parts)), rows.select("subject_id", "fold", "c", "b"), 2, 32, grid, pca_options={"oversample": 24})


def whole_stratified(spark, sf, cached: bool = False):
    """Each label group's best CCA of all 32 x 32 values, covariates removed; `cached` from fold moments written once."""
    from pairlens.operators.splits import split_by_label

    rows = coupling.assign_splits(split_by_label(pairs(spark, sf)), group="grp")
    grid, path = reports.config_grid(spark, ["cca"], [2, 8], []), None
    if cached:
        path = scratch_path(spark, "group-moments")
        coupling.materialize_moments(coupling.split_moments(rows, z_full(), ["grp"]), path, ["grp"])
        rows = rows.limit(0)
    return coupling.stratified_coupling(rows, z_full(), L_FULL, grid, cache_path=path)


def whole_permutations(spark, sf, n_perm: int = 200):
    """Observed and permuted canonical correlations of all 32 x 32 values, covariates removed."""
    return permutation.permutation_null_rows(pairs(spark, sf), z_full(), L_FULL, n_perm=n_perm, k=32)


def _in_range(*columns: str):
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c).between(-1, 1), F.lit(False))
    return ok.alias("finished")


@register(
    "coupling_grid_whole",
    psql("SELECT m || '_pca' || d || c AS config, true AS finished FROM (VALUES ('cca', ''), ('scca', '_c0.3_0.3')) AS t(m, c), (VALUES (2), (8), (32)) AS v(d)"),
)
def coupling_grid_whole(spark, sf):
    return whole_grid(spark, sf).select("config", _in_range("mean_train", "mean_val", "r_train_final", "r_holdout"))


@register("coupling_grid_wide_whole", psql("SELECT 'cca_pca' || d AS config, true AS finished FROM (VALUES (2), (8)) AS v(d)"))
def coupling_grid_wide_whole(spark, sf):
    return whole_grid_wide(spark, sf).select("config", _in_range("mean_train", "mean_val", "r_train_final", "r_holdout"))


@register("stratified_coupling_whole", psql("SELECT true AS finished"))
def stratified_coupling_whole(spark, sf):
    return whole_stratified(spark, sf).select(_in_range("r_case", "r_control"))


@register("stratified_coupling_cached_whole", psql("SELECT true AS finished"))
def stratified_coupling_cached_whole(spark, sf):
    return whole_stratified(spark, sf, cached=True).select(_in_range("r_case", "r_control"))


@register("permutation_test_rows_whole", psql("SELECT CAST(c AS INTEGER) AS component, CAST(200 AS BIGINT) AS n_perm, true AS p_in_range FROM range(32) AS r(c)"))
def permutation_test_rows_whole(spark, sf):
    observed, null = whole_permutations(spark, sf)
    obs = spark.createDataFrame([(i, float(r)) for i, r in enumerate(observed)], "component int, r_obs double")
    got = reports.perm_pvalue(null, obs, ["component"])
    return got.select("component", "n_perm", F.col("p_value").between(1 / 201, 1).alias("p_in_range"))


@register(
    "best_config_by_holdout",
    psql(f"SELECT 'cca_pca2' AS config, {r6('max(r_eval) FILTER (WHERE f = -1)')} AS r_holdout, true AS selected_on_holdout FROM sc", **_SPLIT, **cca22("tr", "f"), **_GRID_TAIL),
)
def best_config_by_holdout(spark, sf):
    rows = coupling.assign_splits(pairs(spark, sf))
    got = coupling.coupling_grid(rows, z_2x2(), L_2X2, reports.config_grid(spark, ["cca"], [2], []), n_components=1)
    return round_columns(export.best_by_holdout(got).select("config", "r_holdout", "selected_on_holdout"), "r_holdout")


@register(
    "best_fit_export",
    psql(
        f"SELECT subject_id, CAST(fold AS INTEGER) AS fold, {r6('abs((u - mu) / su)')} AS u_abs FROM (SELECT subject_id, fold, a1*e1 + a2*e2 AS u FROM fo, w2), (SELECT avg(a1*e1 + a2*e2) AS mu, stddev_pop(a1*e1 + a2*e2) AS su FROM fo, w2 WHERE fold >= 0)",
        **_SPLIT, **cca22("tr", "f"), w2="SELECT * FROM w WHERE f = -1",
    ),
)
def best_fit_export(spark, sf):
    """Variates of the refitted configuration, scaled on its training rows."""
    rows = coupling.assign_splits(pairs(spark, sf))
    got = export.best_fit_export(rows, z_2x2(), L_2X2, "cca", 2)
    return round_columns(got["variates"].select("subject_id", "fold", F.abs(F.col("u")[0]).alias("u_abs")), "u_abs")


@register(
    "best_fit_tables",
    psql("SELECT 'y_loadings' AS part, CAST(6 AS BIGINT) AS n, true AS ok UNION ALL SELECT 'genes', 16, true UNION ALL SELECT 'correlations', 2, true"),
)
def best_fit_tables(spark, sf):
    rows = coupling.assign_splits(pairs(spark, sf))
    got = export.best_fit_export(rows, z_full(), L_FULL, "scca", 6, 0.3, 0.3, k=2)
    top = export.top_loadings(got, 3)
    genes = export.gene_level(got, F.concat(F.lit("g"), F.floor(F.col("position") / 2).cast("string")))
    parts = [
        top.agg(F.lit("y_loadings").alias("part"), F.count(F.lit(1)).alias("n"), F.bool_and(F.abs("weight") <= 1 + 1e-9).alias("ok")),
        genes.agg(F.lit("genes").alias("part"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("l2") >= F.col("mean_abs")).alias("ok")),
        got["correlations"].agg(F.lit("correlations").alias("part"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("r_train").between(-1, 1)).alias("ok")),
    ]
    return reports.union_results(*parts)


@register(
    "interpretable_scca",
    psql("SELECT CAST(f - 1 AS INTEGER) AS fold, CAST(c AS INTEGER) AS component, true AS r_in_range, true AS sparsity_in_range FROM range(6) AS a(f), range(2) AS b(c)"),
)
def interpretable_scca(spark, sf):
    got = interpretable.interpretable_scca(coupling.assign_splits(pairs(spark, sf)), z_full(), L_FULL, 2, projection="paper")
    return got["folds"].select(
        "fold", "component", (F.col("r_train").between(-1, 1) & F.col("r_val").between(-1, 1)).alias("r_in_range"),
        (F.col("sparsity_x").between(0, 1) & F.col("sparsity_y").between(0, 1)).alias("sparsity_in_range"),
    )
