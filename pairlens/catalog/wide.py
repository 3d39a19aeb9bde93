"""The wide view kept as feature blocks: all 32 values of the first view in four blocks of 8, all 32 of the second, covariates removed.

The SQL refits the same models on all 64 values for one component: residuals and scales, the leading component by repeated squaring
of the covariance, and its regression on the second view by elimination.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog.estimators import _GRID_COLS, _GROUP_SPLIT, _SPLIT, pairs, psql
from pairlens.catalog.fixtures import r6, round_columns
from pairlens.catalog.registry import register
from pairlens.operators import reports
from pairlens.operators.splits import split_by_label
from pairlens.plans import coupling, wide


def whole_cca(parts: str, scales: str | None = None) -> dict[str, str]:
    """CTEs of the first canonical pair of the leading component of values 1-32 with values 33-64, for every f of `parts`.

    `parts` selects f, role ('train' or 'eval'), subject_id, a, g, e. `tu` has the pair's scores t and u per subject, `rr` their correlation per f and role.
    `scales` (j, sd) replaces the scales of values 1-32 that come from the training rows.
    """
    one = "SELECT f, j, stddev_pop(r) AS sd FROM res WHERE role = 'train' GROUP BY f, j"
    if scales:
        one = f"SELECT f, j, CASE WHEN j < 32 THEN fixed.sd ELSE own.sd END AS sd FROM ({one}) AS own JOIN ({scales}) AS fixed USING (j)"
    return {
        "parts": parts,
        "v": "SELECT f, role, subject_id, a, g, unnest(e) AS v, unnest(range(64)) AS j FROM parts",
        "st": "SELECT f, j, covar_pop(a, a) AS saa, covar_pop(g, g) AS sgg, covar_pop(a, g) AS sag, avg(a) AS ma, avg(g) AS mg, covar_pop(a, v) AS sa, covar_pop(g, v) AS sg, avg(v) AS m FROM v WHERE role = 'train' GROUP BY f, j",
        "co": "SELECT *, (sa * sgg - sg * sag) / (saa * sgg - sag * sag) AS ba, (sg * saa - sa * sag) / (saa * sgg - sag * sag) AS bg FROM st",
        "res": "SELECT f, role, subject_id, j, v - m - ba * (a - ma) - bg * (g - mg) AS r FROM v JOIN co USING (f, j)",
        "sc": one,
        "zz": "SELECT f, role, subject_id, list(r / sd ORDER BY j) AS z FROM res JOIN sc USING (f, j) GROUP BY f, role, subject_id",
        "gr": "SELECT f, i, j, sum(z[i] * z[j]) / count(*) AS s FROM zz, range(1, 65) AS p(i), range(1, 65) AS q(j) WHERE role = 'train' GROUP BY f, i, j",
        "rw": "SELECT f, i, list(s ORDER BY j) AS line FROM gr GROUP BY f, i",
        "ma2": "SELECT f, list(line ORDER BY i) AS m FROM rw GROUP BY f",
        "sq": "SELECT f, 0 AS k, [r[1:32] for r in m[1:32]] AS p FROM ma2 UNION ALL SELECT f, k + 1, [[list_dot_product(r, c) / (t * t) for c in p] for r in p] "
        "FROM (SELECT f, k, p, list_sum([p[i][i] for i in range(1, 33)]) AS t FROM sq WHERE k < 16)",
        "ve": "SELECT f, [x / sqrt(list_dot_product(w, w)) for x in w] AS v FROM (SELECT f, p[list_position(d, list_max(d))] AS w FROM (SELECT f, p, [p[i][i] for i in range(1, 33)] AS d FROM sq WHERE k = 16))",
        "ga": "SELECT ma2.f AS f, 0 AS k, [list_concat(m[i][33:64], [list_dot_product(m[i][1:32], v)]) for i in range(33, 65)] AS a FROM ma2 JOIN ve ON ma2.f = ve.f UNION ALL "
        "SELECT f, k + 1, [CASE WHEN i = k + 1 THEN piv ELSE [a[i][c] - a[i][k + 1] * piv[c] for c in range(1, 34)] END for i in range(1, 33)] "
        "FROM (SELECT f, k, a, [x / a[k + 1][k + 1] for x in a[k + 1]] AS piv FROM ga WHERE k < 32)",
        "be": "SELECT f, [r[33] for r in a] AS b FROM ga WHERE k = 32",
        "tu": "SELECT zz.f AS f, role, subject_id, z, v, list_dot_product(z[1:32], v) AS t, list_dot_product(z[33:64], b) AS u FROM zz JOIN ve ON zz.f = ve.f JOIN be ON zz.f = be.f",
        "rr": "SELECT f, role, corr(t, u) AS r FROM tu GROUP BY f, role",
    }


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_FOLD_SPLIT = {k: v for k, v in _SPLIT.items() if k != "tr"}
_FOLD_PARTS = "SELECT f, CASE WHEN fold = f THEN 'eval' ELSE 'train' END AS role, subject_id, a, g, e FROM fo, folds WHERE fold = f OR fold >= 0"
WHOLE_GRID_SQL = recursive(
    psql(
        f"SELECT 'cca_pca1' AS config, {r6('avg(r) FILTER (WHERE f >= 0 AND tr)')} AS mean_train, {r6('avg(r) FILTER (WHERE f >= 0 AND NOT tr)')} AS mean_val, {r6('stddev_pop(r) FILTER (WHERE f >= 0 AND NOT tr)')} AS std_val, "
        f"{r6('max(r) FILTER (WHERE f = -1 AND tr)')} AS r_train_final, {r6('max(r) FILTER (WHERE f = -1 AND NOT tr)')} AS r_holdout FROM (SELECT *, role = 'train' AS tr FROM rr)",
        **_FOLD_SPLIT, **whole_cca(_FOLD_PARTS),
    )
)


def gene_blocks(rows, width: int = 8):
    """(subject_id, gene, embedding): the first view in blocks."""
    parts = F.array(*[F.struct(F.lit(f"g{i}").alias("gene"), F.slice("x", width * i + 1, width).alias("embedding")) for i in range(32 // width)])
    return rows.select("subject_id", F.inline(parts))


def _side(rows, *more: str):
    return rows.select("subject_id", "c", "b", *more)


@register("dual_grid", WHOLE_GRID_SQL)
def dual_grid(spark, sf):
    """Cross-validated coupling of feature blocks with the second view; every fold's PCA from one pass over the blocks."""
    rows = coupling.assign_splits(pairs(spark, sf))
    got = wide.dual_grid(gene_blocks(rows), _side(rows, "fold"), reports.config_grid(spark, ["cca"], [1], []), n_components=1)
    return round_columns(got.select("config", *_GRID_COLS), *_GRID_COLS)


_GROUP_PARTS = "SELECT y AS f, CASE WHEN fold = -1 THEN 'eval' ELSE 'train' END AS role, subject_id, a, g, e FROM fo"
_OF = "max(r) FILTER (WHERE f = {} AND role = 'eval')"
_WEIGHTS = {
    "su": "SELECT f, stddev_pop(t) AS st FROM tu WHERE role = 'train' GROUP BY f",
    "xw": "SELECT DISTINCT ve.f AS f, unnest(v) / st AS w, unnest(range(32)) AS j FROM ve JOIN su ON ve.f = su.f",
}
STRATIFIED_SQL = recursive(
    psql(
        f"SELECT 'cca_pca1' AS case_config, 'cca_pca1' AS control_config, {r6(_OF.format(1))} AS r_case, {r6(_OF.format(0))} AS r_control, {r6(_OF.format(1) + ' - ' + _OF.format(0))} AS r_diff, "
        f"{r6('(SELECT abs(sum(p.w * q.w)) / sqrt(sum(p.w * p.w) * sum(q.w * q.w)) FROM xw p JOIN xw q ON p.j = q.j AND p.f = 1 AND q.f = 0)')} AS x_cosine_abs FROM rr",
        fo=_GROUP_SPLIT["fo"], **whole_cca(_GROUP_PARTS), **_WEIGHTS,
    )
)
_STRATIFIED_COLS = ["r_case", "r_control", "r_diff", "x_cosine_abs"]


@register("dual_stratified", STRATIFIED_SQL)
def dual_stratified(spark, sf):
    """Coupling per label group, both groups' folds from one pass over the blocks, compared on single features."""
    rows = coupling.assign_splits(split_by_label(pairs(spark, sf)), group="grp")
    got = wide.wide_stratified(gene_blocks(rows), _side(rows, "fold", "grp"), reports.config_grid(spark, ["cca"], [1], []), n_components=1)
    return round_columns(got.select("case_config", "control_config", "r_case", "r_control", "r_diff", F.abs("x_weight_cosine").alias("x_cosine_abs")), *_STRATIFIED_COLS)


N_PERM = 6
_PERM = {
    "pm": f"SELECT p, subject_id, a, g, e, row_number() OVER (PARTITION BY p ORDER BY md5(subject_id || '|42|' || p), subject_id) AS rn, (SELECT count(*) FROM pairs WHERE y = 1) AS n1, (SELECT count(*) FROM pairs) AS n FROM pairs, range({N_PERM}) AS r(p)",
    "pg": "SELECT p, subject_id, a, g, e, CASE WHEN rn <= n1 THEN 1 ELSE 0 END AS grp, CASE WHEN rn <= n1 THEN rn ELSE rn - n1 END AS place, CASE WHEN rn <= n1 THEN n1 ELSE n - n1 END AS size FROM pm",
}
_PERM_PARTS = "SELECT 2 * p + grp AS f, CASE WHEN place <= ceil(0.2 * size) THEN 'eval' ELSE 'train' END AS role, subject_id, a, g, e FROM pg"
_ALL_SCALES = {
    "av": "SELECT subject_id, a, g, unnest(e) AS v, unnest(range(64)) AS j FROM pairs",
    "ast": "SELECT j, covar_pop(a, a) AS saa, covar_pop(g, g) AS sgg, covar_pop(a, g) AS sag, avg(a) AS ma, avg(g) AS mg, covar_pop(a, v) AS sa, covar_pop(g, v) AS sg, avg(v) AS m FROM av GROUP BY j",
    "asd": "SELECT j, stddev_pop(v - m - (sa * sgg - sg * sag) / (saa * sgg - sag * sag) * (a - ma) - (sg * saa - sa * sag) / (saa * sgg - sag * sag) * (g - mg)) AS sd FROM av JOIN ast USING (j) GROUP BY j",
}


def _null_sql(scales: str | None) -> str:
    extra = _PERM | (_ALL_SCALES if scales else {}) | whole_cca(_PERM_PARTS, scales)
    r1, r0 = "max(r) FILTER (WHERE f % 2 = 1)", "max(r) FILTER (WHERE f % 2 = 0)"
    return recursive(psql(f"SELECT CAST(f // 2 AS INTEGER) AS perm_id, {r6(r1)} AS r_case, {r6(r0)} AS r_control, {r6(f'{r1} - {r0}')} AS diff FROM rr WHERE role = 'eval' GROUP BY f // 2", **extra))


def _null(spark, sf, scales: str):
    rows = pairs(spark, sf)
    null = wide.wide_label_null(gene_blocks(rows), _side(rows, "y"), N_PERM, "cca", 1, scales=scales)
    return round_columns(null, "r_case", "r_control", "diff")


@register("dual_label_null", _null_sql("SELECT j, sd FROM asd"))
def dual_label_null(spark, sf):
    """Holdout correlations of both groups under permuted labels; all permutations are selections of one matrix."""
    return _null(spark, sf, "all")


@register("dual_label_null_refit", _null_sql(None))
def dual_label_null_refit(spark, sf):
    """The same with the scales of every permuted group refitted as well."""
    return _null(spark, sf, "train")


_FINAL = {"fo": _SPLIT["fo"]} | {k: _SPLIT[k] for k in ("sizes", "shares", "quota")}
_FINAL = {k: _FINAL[k] for k in ("sizes", "shares", "quota", "fo")} | whole_cca("SELECT -1 AS f, CASE WHEN fold = -1 THEN 'eval' ELSE 'train' END AS role, subject_id, a, g, e FROM fo") | _WEIGHTS
_GENE_NAME = "'g' || (j // 8)"


def _export(spark, sf):
    rows = coupling.assign_splits(pairs(spark, sf))
    return wide.wide_export(gene_blocks(rows), _side(rows, "fold"), "cca", 1)


@register(
    "dual_export",
    recursive(
        psql(
            f"SELECT {_GENE_NAME} AS gene, CAST(j % 8 AS INTEGER) AS dim, {r6('abs(w)')} AS weight_abs, {r6('abs(l)')} AS loading_abs FROM xw JOIN (SELECT j, corr(z[j + 1], t) AS l FROM tu, range(32) AS r(j) WHERE role = 'train' GROUP BY j) USING (j)",
            **_FINAL,
        )
    ),
)
def dual_export(spark, sf):
    """Weights and loadings of every single feature of the blocks, from a second pass over them."""
    x = _export(spark, sf)["x_weights"]
    return round_columns(x.select("gene", "dim", F.abs("weight").alias("weight_abs"), F.abs("loading").alias("loading_abs")), "weight_abs", "loading_abs")


@register(
    "dual_export_variates",
    recursive(psql(f"SELECT subject_id, CASE WHEN role = 'eval' THEN -1 ELSE 0 END AS part, {r6('abs(t) / st')} AS u_abs, {r6('abs(u) / sv')} AS v_abs FROM tu JOIN su USING (f), (SELECT stddev_pop(u) AS sv FROM tu WHERE role = 'train')", **_FINAL)),
)
def dual_export_variates(spark, sf):
    """Variates of every subject under the model of the training rows."""
    got = _export(spark, sf)["variates"]
    side = F.when(F.col("fold") == coupling.HOLDOUT, -1).otherwise(0).alias("part")
    return round_columns(got.select("subject_id", side, F.abs(F.col("u")[0]).alias("u_abs"), F.abs(F.col("v")[0]).alias("v_abs")), "u_abs", "v_abs")


@register("dual_export_genes", recursive(psql(f"SELECT {_GENE_NAME} AS gene, {r6('sqrt(sum(w * w))')} AS l2, {r6('avg(abs(w))')} AS mean_abs FROM xw GROUP BY 1", **_FINAL)))
def dual_export_genes(spark, sf):
    """The weights rolled up to gene blocks."""
    return round_columns(_export(spark, sf)["genes"].select("gene", "l2", "mean_abs"), "l2", "mean_abs")


@register("coupling_grid_values", WHOLE_GRID_SQL)
def coupling_grid_values(spark, sf):
    """The moment grid on all 32 x 32 values, by value."""
    from pairlens.catalog.estimators import L_FULL, z_full

    got = coupling.coupling_grid(coupling.assign_splits(pairs(spark, sf)), z_full(), L_FULL, reports.config_grid(spark, ["cca"], [1], []), n_components=1)
    return round_columns(got.select("config", *_GRID_COLS), *_GRID_COLS)


@register("coupling_grid_wide_values", WHOLE_GRID_SQL)
def coupling_grid_wide_values(spark, sf):
    """The grid by repeated block PCA on all 32 x 32 values, by value."""
    rows = coupling.assign_splits(pairs(spark, sf))
    got = coupling.wide_coupling_grid(gene_blocks(rows), _side(rows, "fold"), 2, 32, reports.config_grid(spark, ["cca"], [1], []), n_components=1, pca_options={"oversample": 31})
    return round_columns(got.select("config", *_GRID_COLS), *_GRID_COLS)


def _stratified_values(got):
    return round_columns(got.select("case_config", "control_config", "r_case", "r_control", "r_diff", F.abs("x_weight_cosine").alias("x_cosine_abs")), *_STRATIFIED_COLS)


@register("stratified_coupling_values", STRATIFIED_SQL)
def stratified_coupling_values(spark, sf):
    """The moment comparison of both groups on all 32 x 32 values, by value."""
    from pairlens.catalog.estimators import L_FULL, z_full

    rows = coupling.assign_splits(split_by_label(pairs(spark, sf)), group="grp")
    return _stratified_values(coupling.stratified_coupling(rows, z_full(), L_FULL, reports.config_grid(spark, ["cca"], [1], []), n_components=1))


# ---- sparse weights on single features ------------------------------------------------

_PAIR = {k: v for k, v in whole_cca("SELECT -1 AS f, CASE WHEN fold = -1 THEN 'eval' ELSE 'train' END AS role, subject_id, a, g, e FROM fo").items() if k not in ("sq", "ve", "ga", "be", "tu", "rr")} | {
    "xy": "SELECT [r[33:64] for r in m[1:32]] AS s FROM ma2",
    "yx": "SELECT s, [[r[j] for r in s] for j in range(1, 33)] AS st FROM xy",
    "sq": "SELECT 0 AS k, [[list_dot_product(a, b) for b in st] for a in st] AS p FROM yx UNION ALL SELECT k + 1, [[list_dot_product(r, c) / (t * t) for c in p] for r in p] "
    "FROM (SELECT k, p, list_sum([p[i][i] for i in range(1, 33)]) AS t FROM sq WHERE k < 16)",
    "sv": "SELECT [x / sqrt(list_dot_product(w, w)) for x in w] AS v FROM (SELECT p[list_position(d, list_max(d))] AS w FROM (SELECT p, [p[i][i] for i in range(1, 33)] AS d FROM sq WHERE k = 16))",
    "su": "SELECT v, [x / sqrt(list_dot_product(w, w)) for x in w] AS u FROM (SELECT v, [list_dot_product(r, v) for r in s] AS w FROM xy, sv)",
    "sc2": "SELECT role, corr(list_dot_product(z[1:32], u), list_dot_product(z[33:64], v)) AS r FROM zz, su GROUP BY role",
}
_SINGULAR = {k: _SPLIT[k] for k in ("sizes", "shares", "quota", "fo")} | _PAIR


@register(
    "block_scca",
    recursive(
        psql(
            f"SELECT 'x' AS view, CAST(i - 1 AS INTEGER) AS feature, {r6('abs(u[i])')} AS weight_abs, {r6('r1')} AS r_train, {r6('r2')} AS r_holdout FROM su, range(1, 33) AS r(i), o "
            f"UNION ALL SELECT 'y', CAST(i - 1 AS INTEGER), {r6('abs(v[i])')}, {r6('r1')}, {r6('r2')} FROM su, range(1, 33) AS r(i), o",
            **_SINGULAR, o="SELECT max(r) FILTER (WHERE role = 'train') AS r1, max(r) FILTER (WHERE role = 'eval') AS r2 FROM sc2",
        )
    ),
)
def block_scca(spark, sf):
    """Weights of the single features from steps over the blocks; bounds that do not bind, where the solution is the leading singular pair."""
    rows = coupling.assign_splits(pairs(spark, sf))
    got = wide.wide_sparse(gene_blocks(rows), _side(rows, "fold"), 1, 1.0, 1.0, cv=False)
    x = got["x_weights"].select(F.lit("x").alias("view"), (F.substring("gene", 2, 9).cast("int") * 8 + F.col("dim")).alias("feature"), "weight")
    y = got["y_weights"].select(F.lit("y").alias("view"), F.col("position").alias("feature"), "weight")
    r = got["folds"].select("r_train", F.col("r_val").alias("r_holdout"))
    out = x.unionByName(y).crossJoin(r)  # one row of correlations
    return round_columns(out.select("view", "feature", F.abs("weight").alias("weight_abs"), "r_train", "r_holdout"), "weight_abs", "r_train", "r_holdout")


@register(
    "block_scca_sparse",
    psql("SELECT CAST(0 AS INTEGER) AS component, CAST(32 AS BIGINT) AS n_features, true AS unit_norm, true AS within_bound, true AS some_zero FROM pairs LIMIT 1"),
)
def block_scca_sparse(spark, sf):
    """Binding bounds on the unit vectors; the values equal the dense solver's in tests/test_block_scca.py."""
    from pairlens.operators.solve import l1_bound

    rows = coupling.assign_splits(pairs(spark, sf))
    x = wide.wide_sparse(gene_blocks(rows), _side(rows, "fold"), 1, 0.3, 0.3, cv=False, projection="paper", max_iter=20, tol=1e-4)["x_weights"]
    return x.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_features"), (F.abs(F.sum(F.col("weight") * F.col("weight")) - 1) < 1e-6).alias("unit_norm"),
        (F.sum(F.abs("weight")) <= l1_bound(0.3, 32) + 1e-6).alias("within_bound"), (F.count_if(F.col("weight") == 0) > 0).alias("some_zero"),
    )
