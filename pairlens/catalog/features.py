"""Feature construction, projections and scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens import functions as fn
from pairlens.catalog import fixtures as fx
from pairlens.catalog.fixtures import GENES, r6, round_columns, sql
from pairlens.catalog.registry import register
from pairlens.operators import align, connectivity, features, moments, qc, splits

_POOL_SQL = {m: sql("block_values", f"SELECT subject_id, gene, {r6(f'{f}(v)')} AS value FROM block_values GROUP BY 1, 2")
             for m, f in (("mean", "avg"), ("max", "max"), ("median", "median"))}


def _pooled(spark, sf, method="mean"):
    return features.pool_embedding(fx.blocks(spark, sf), method=method).select("subject_id", "gene", "value")


@register("pool_mean", _POOL_SQL["mean"])
def pool_mean(spark, sf):
    return round_columns(_pooled(spark, sf, "mean"), "value")


@register("pool_max", _POOL_SQL["max"])
def pool_max(spark, sf):
    return round_columns(_pooled(spark, sf, "max"), "value")


@register("pool_median", _POOL_SQL["median"])
def pool_median(spark, sf):
    return round_columns(_pooled(spark, sf, "median"), "value")


@register(
    "pool_vectorized",
    sql("block_values", "SELECT subject_id, gene, method, " + r6("value") + " AS value FROM ("
        + " UNION ALL ".join(f"SELECT subject_id, gene, '{m}' AS method, {f}(v) FILTER (WHERE v >= 0) AS value FROM block_values GROUP BY 1, 2" for m, f in (("mean", "avg"), ("max", "max"), ("median", "median"))) + ")"),
)
def pool_vectorized(spark, sf):
    """All three methods on whole Arrow batches, negative elements replaced by NaN first."""
    nan = F.lit(float("nan")).cast("float")
    spoiled = fx.blocks(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: F.when(x < 0, nan).otherwise(x)))
    parts = [
        features.pool_embedding(spoiled.select("subject_id", "gene", "embedding"), method=m, vectorized=True).withColumn("method", F.lit(m))
        for m in ("mean", "max", "median")
    ]
    return round_columns(parts[0].unionByName(parts[1]).unionByName(parts[2]), "value")


@register(
    "pool_nan",
    sql(
        "block_values",
        f"SELECT subject_id, gene, {r6('avg(v) FILTER (WHERE v >= 0)')} AS value FROM block_values GROUP BY 1, 2",
    ),
)
def pool_nan(spark, sf):
    """Pooling ignores NaN elements (here: the negative ones); nothing left gives NULL."""
    nan = F.lit(float("nan")).cast("float")
    spoiled = fx.blocks(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: F.when(x < 0, nan).otherwise(x)))
    return round_columns(features.pool_embedding(spoiled).select("subject_id", "gene", "value"), "value")


@register(
    "gene_matrix",
    sql(
        "block_values",
        "SELECT subject_id, " + ", ".join(r6(f"avg(v) FILTER (WHERE gene = '{g}')") + f" AS {g}" for g in GENES) + " FROM block_values GROUP BY subject_id",
    ),
)
def gene_matrix(spark, sf):
    return round_columns(features.gene_matrix(_pooled(spark, sf), GENES), *GENES)


@register(
    "gene_array",
    sql(
        "block_values",
        f"SELECT subject_id, CAST(8 AS INTEGER) AS n_genes, {r6('sum(m * (g + 1))')} AS weighted FROM p GROUP BY subject_id",
        p="SELECT subject_id, CAST(substr(gene, 2) AS INTEGER) AS g, avg(v) AS m FROM block_values GROUP BY 1, 2",
    ),
)
def gene_array(spark, sf):
    arr = features.gene_array(_pooled(spark, sf), GENES)
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return round_columns(arr.select("subject_id", F.size("features").alias("n_genes"), weighted.alias("weighted")), "weighted")


@register(
    "widen_genes",
    "SELECT CAST(vec_id AS VARCHAR) AS subject_id, CAST(len(embedding) AS INTEGER) AS width, "
    + r6("list_sum([CAST(embedding[d] AS DOUBLE) * d for d in range(1, 65)])") + " AS weighted FROM embeddings",
)
def widen_genes(spark, sf):
    wide = features.widen_genes(fx.blocks(spark, sf), GENES)
    weighted = F.aggregate(F.transform("features", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return round_columns(wide.select("subject_id", F.size("features").alias("width"), weighted.alias("weighted")), "weighted")


@register("orient_timeseries", sql("ts", f"SELECT subject_id, t, roi, {r6('value')} AS value FROM ts"))
def orient_timeseries(spark, sf):
    series = fx.ts(spark, sf)
    turned = F.col("subject_id").cast("long") % 2 == 0
    mixed = series.select(
        "subject_id", F.when(turned, F.col("roi")).otherwise(F.col("t")).alias("t"), F.when(turned, F.col("t")).otherwise(F.col("roi")).alias("roi"), "value"
    )
    return round_columns(connectivity.orient_timeseries(mixed), "value")


_ROI_NAMES_SQL = "SELECT p_partkey AS roi, '17Networks_LH_' || replace(p_brand, '#', '') || '_' || CAST(p_size AS VARCHAR) AS roi_name FROM part"


def _roi_names(spark, sf):
    p = fx.table(spark, sf, "part")
    name = F.concat_ws("_", F.lit("17Networks"), F.lit("LH"), F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("roi"), name.alias("roi_name"))


@register(
    "select_networks",
    f"SELECT roi, roi_name, split_part(roi_name, '_', 3) AS network FROM ({_ROI_NAMES_SQL}) WHERE split_part(roi_name, '_', 3) IN ('Brand11', 'Brand23', 'Brand45')",
)
def select_networks(spark, sf):
    kept = connectivity.select_networks(_roi_names(spark, sf), ["Brand11", "Brand23", "Brand45"])
    return kept.withColumn("network", fn.network_of("roi_name"))


_NET17 = list(connectivity.NETWORK_17_TO_7)
_MAP_SQL = "CASE network17 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in connectivity.NETWORK_17_TO_7.items()) + " END"


@register(
    "map_networks",
    f"SELECT roi, network17, {_MAP_SQL} AS network7 FROM (SELECT p_partkey AS roi, ([" + ", ".join(f"'{n}'" for n in _NET17) + "])[p_size % 17 + 1] AS network17 FROM part)",
)
def map_networks(spark, sf):
    p = fx.table(spark, sf, "part")
    names = F.array(*[F.lit(n) for n in _NET17])
    rois = p.select(F.col("p_partkey").alias("roi"), F.get(names, F.col("p_size") % 17).alias("network17"))
    return connectivity.map_networks(rois)


@register("apply_valid_mask", sql("cov", "SELECT subject_id, age, sex FROM cov WHERE valid"))
def apply_valid_mask(spark, sf):
    return align.apply_valid_mask(fx.cov(spark, sf))


@register("drop_nan_rows", sql("tab", f"SELECT subject_id, {r6('f0')} AS f0, {r6('f1')} AS f1 FROM tab WHERE CAST(subject_id AS BIGINT) % 17 <> 0"))
def drop_nan_rows(spark, sf):
    kept = qc.drop_nan_rows(fx.tab_nan(spark, sf))
    return round_columns(kept.select("subject_id", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1")), "f0", "f1")


@register(
    "drop_report",
    sql("tab", "SELECT count(*) AS n_input, count(*) FILTER (WHERE CAST(subject_id AS BIGINT) % 17 <> 0) AS n_kept, count(*) FILTER (WHERE CAST(subject_id AS BIGINT) % 17 = 0) AS n_dropped FROM tab"),
)
def drop_report(spark, sf):
    return qc.drop_report(fx.tab_nan(spark, sf))


def _tab_wide(spark, sf):
    return fx.tab(spark, sf).select("subject_id", *[F.col("features")[i].alias(f"f{i}") for i in range(6)])


@register("extract_covariate", sql("tab", f"SELECT subject_id, {r6('f4')} AS extra FROM tab"))
def extract_covariate(spark, sf):
    return round_columns(features.extract_covariate(_tab_wide(spark, sf), "f4").select("subject_id", "extra"), "extra")


@register("drop_features", sql("tab", f"SELECT subject_id, {r6('f0')} AS f0, {r6('f2')} AS f2, {r6('f3')} AS f3, {r6('f5')} AS f5 FROM tab"))
def drop_features(spark, sf):
    return round_columns(features.drop_features(_tab_wide(spark, sf), ["f1", "f4"]), "f0", "f2", "f3", "f5")


@register(
    "drop_feature_rows",
    sql("tab", f"SELECT feature, count(*) AS n, {r6('sum(v)')} AS total FROM (UNPIVOT (SELECT f0, f1, f2, f3, f4, f5 FROM tab) ON f0, f1, f2, f3, f4, f5 INTO NAME feature VALUE v) WHERE feature NOT IN ('f1', 'f4') GROUP BY 1"),
)
def drop_feature_rows(spark, sf):
    long = fx.tab(spark, sf).select("subject_id", F.posexplode("features").alias("p", "v")).withColumn("feature", F.concat(F.lit("f"), "p"))
    kept = features.drop_feature_rows(long, ["f1", "f4"])
    return round_columns(kept.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total")


@register("binarize_label", "SELECT l_orderkey, l_linenumber, CAST(l_linestatus = 'O' AS INTEGER) AS y FROM lineitem")
def binarize_label(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", 7).otherwise(3).alias("y"))
    return splits.binarize_label(rows)


@register("split_by_label", sql("emb", "SELECT CASE WHEN y = 1 THEN 'case' ELSE 'control' END AS grp, count(*) AS n, min(subject_id) AS first_id FROM emb GROUP BY 1"))
def split_by_label(spark, sf):
    return splits.split_by_label(fx.emb(spark, sf)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("subject_id").alias("first_id"))


@register(
    "build_covariates",
    sql("cov tab", f"SELECT subject_id, CAST(4 AS INTEGER) AS width, {r6('1.0 + age + sex + f4')} AS total FROM cov JOIN tab USING (subject_id)"),
)
def build_covariates(spark, sf):
    joined = fx.cov(spark, sf).join(_tab_wide(spark, sf), "subject_id")
    c = moments.z_vector(moments.build_covariates("age", "sex", extra=F.array("f4")))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    return round_columns(joined.select("subject_id", c.alias("c")).select("subject_id", F.size("c").alias("width"), total.alias("total")), "total")


def _weighted_sql(values: str) -> str:
    return r6(f"list_sum(list_transform({values}, lambda x, i: x * i))")


def _weighted(values):
    """A sum in which every value has its own weight, its position."""
    return F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


_UV = "SELECT subject_id, CAST(embedding AS DOUBLE[])[1:32] AS u, CAST(embedding AS DOUBLE[])[33:64] AS v FROM emb"
_SETS = {"gene_only": "u", "fmri_only": "v", "joint": "list_concat(u, v)", "joint_mean": "list_transform(list_zip(u, v), lambda p: (p[1] + p[2]) / 2)"}


@register(
    "feature_sets",
    sql(
        "emb",
        " UNION ALL ".join(f"SELECT subject_id, '{name}' AS feature_set, CAST(len({values}) AS INTEGER) AS width, {_weighted_sql(values)} AS weighted FROM uv" for name, values in _SETS.items()),
        uv=_UV,
    ),
)
def feature_sets(spark, sf):
    e = fx.emb(spark, sf).withColumn("e", F.col("embedding").cast("array<double>"))
    uv = e.select("subject_id", F.slice("e", 1, 32).alias("u"), F.slice("e", 33, 32).alias("v"))
    long = features.feature_sets(uv, list(_SETS))
    return round_columns(long.select("subject_id", "feature_set", F.size("features").alias("width"), _weighted("features").alias("weighted")), "weighted")


@register(
    "early_fusion",
    sql("emb tab", f"SELECT subject_id, CAST(70 AS INTEGER) AS width, {_weighted_sql('list_concat(CAST(embedding AS DOUBLE[]), [f0, f1, f2, f3, f4, f5])')} AS weighted FROM emb JOIN tab USING (subject_id)"),
)
def early_fusion(spark, sf):
    joined = fx.emb(spark, sf).join(fx.tab(spark, sf), "subject_id")
    fused = features.early_fusion(F.col("embedding").cast("array<double>"), F.col("features"))
    return round_columns(joined.select("subject_id", F.size(fused).alias("width"), _weighted(fused).alias("weighted")), "weighted")


@register("residual_projection", sql("emb", f"SELECT subject_id, {_weighted_sql('CAST(embedding AS DOUBLE[])[1:3]')} AS weighted FROM emb"))
def residual_projection(spark, sf):
    e = fx.emb(spark, sf).select("subject_id", features.residual_projection(F.col("embedding").cast("array<double>"), 3).alias("p"))
    return round_columns(e.select("subject_id", _weighted("p").alias("weighted")), "weighted")


# ---- scalar functions -------------------------------------------------------------


@register(
    "fisher_z",
    sql("scores", f"SELECT subject_id, {r6('atanh(greatest(-0.999999, least(0.999999, score * 3)))')} AS z FROM scores"),
)
def fisher_z(spark, sf):
    return round_columns(fx.scores(spark, sf).select("subject_id", fn.fisher_z(F.col("score") * 3).alias("z")), "z")


@register("soft_threshold", sql("scores", f"SELECT subject_id, {r6('sign(score) * greatest(abs(score) - 0.1, 0)')} AS s FROM scores"))
def soft_threshold(spark, sf):
    return round_columns(fx.scores(spark, sf).select("subject_id", fn.soft_threshold("score", 0.1).alias("s")), "s")


@register(
    "edges_and_nodes",
    "SELECT p_partkey, CAST(p_size * (p_size - 1) // 2 AS BIGINT) AS n_edges, CAST(p_size AS BIGINT) AS n_nodes, CAST(p_size - 2 AS BIGINT) AS last_of_first FROM part WHERE p_size >= 2",
)
def edges_and_nodes(spark, sf):
    p = fx.table(spark, sf, "part").filter("p_size >= 2")
    e = p.select("p_partkey", "p_size", F.expr("p_size * (p_size - 1) div 2").alias("n_edges"))
    last = F.col("p_size") - 1
    return e.select(
        "p_partkey", F.col("n_edges").cast("long").alias("n_edges"), fn.nodes_of_edges("n_edges").alias("n_nodes"),
        fn.edge_ordinal(F.lit(0), last, 0).alias("last_of_first"),
    )


@register(
    "percent_difference",
    sql("strat", f"SELECT model, modality, {r6('abs(null_std - p_value) / greatest(null_std, p_value) * 100')} AS percent FROM strat"),
)
def percent_difference(spark, sf):
    return round_columns(fx.strat(spark, sf).select("model", "modality", fn.percent_difference("p_value", "null_std").alias("percent")), "percent")


_CONFIG_SQL = (
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'cca' ELSE 'scca' END AS method, p_size AS dim, (p_partkey % 9 + 1) / 10.0::DOUBLE AS c1, (p_partkey % 7 + 1) / 10.0::DOUBLE AS c2 FROM part"
)


def _configs(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, "cca").otherwise("scca").alias("method"), F.col("p_size").alias("dim"),
        ((F.col("p_partkey") % 9 + 1) / 10).alias("c1"), ((F.col("p_partkey") % 7 + 1) / 10).alias("c2"),
    )


@register(
    "config_label",
    f"SELECT p_partkey, CASE WHEN method = 'cca' THEN 'cca_pca' || dim ELSE 'scca_pca' || dim || '_c' || c1 || '_' || c2 END AS config FROM ({_CONFIG_SQL})",
)
def config_label(spark, sf):
    return _configs(spark, sf).select("p_partkey", fn.config_label("method", "dim", "c1", "c2").alias("config"))


@register(
    "parse_config",
    f"SELECT p_partkey, method, dim, CASE WHEN method = 'scca' THEN c1 END AS c1, CASE WHEN method = 'scca' THEN c2 END AS c2 FROM ({_CONFIG_SQL})",
)
def parse_config(spark, sf):
    labels = _configs(spark, sf).select("p_partkey", fn.config_label("method", "dim", "c1", "c2").alias("config"))
    return labels.select("p_partkey", fn.parse_config("config").alias("c")).select("p_partkey", "c.*")


@register(
    "significance_text",
    sql(
        "strat",
        "SELECT model, modality, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, "
        "CASE WHEN p < 0.001 THEN 'p<.001' ELSE printf('p=%.3f', p) END AS text FROM (SELECT model, modality, p_value * p_value AS p FROM strat)",
    ),
)
def significance_text(spark, sf):
    p = F.col("p_value") * F.col("p_value")
    return fx.strat(spark, sf).select("model", "modality", fn.significance_stars(p).alias("stars"), fn.format_p_value(p).alias("text"))


@register(
    "title_label",
    "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Only' AS title FROM customer",
)
def title_label(spark, sf):
    c = fx.table(spark, sf, "customer")
    return c.select("c_custkey", fn.title_label(F.concat(F.lower("c_mktsegment"), F.lit("_only"))).alias("title"))


@register(
    "subject_key",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) || '_20227_2_0' ELSE CAST(c_custkey AS VARCHAR) || '_run2' END AS subject_key FROM customer",
)
def subject_key(spark, sf):
    c = fx.table(spark, sf, "customer")
    path = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("/roi/x/atlas_s3_"), F.col("c_custkey").cast("string"), F.lit("_run2.npy")))
    return c.select("c_custkey", fn.subject_key(path, F.col("c_custkey").cast("string"), "atlas_s3_").alias("subject_key"))


@register(
    "display_name",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' [' || c_name || ']' WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) || ' [' || c_name || ']' "
    "ELSE 'cat: ' || lower(c_mktsegment) || ' [' || c_name || ']' END AS name FROM customer",
)
def display_name(spark, sf):
    c = fx.table(spark, sf, "customer")
    kind = F.col("c_custkey") % 3
    desc, cat = F.when(kind > 0, F.lower("c_mktsegment")), F.when(kind == 2, "cat")
    return c.select("c_custkey", fn.display_name("c_name", desc, cat, include_col=True).alias("name"))
