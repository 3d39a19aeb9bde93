"""Weight interpretation on mean embeddings per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.catalog.fixtures import r6, round_columns, sql
from pairlens.catalog.registry import register
from pairlens.operators import connectivity, interpret
from pairlens.plans import export

_TOP = (
    "SELECT component, position, feature, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(weight) DESC, position DESC) AS rank FROM weights) WHERE rank <= {k}"
)


@register("sparsity", sql("weights", f"SELECT component, count(*) AS n, {r6('avg(CAST(abs(weight) < 0.02 AS INTEGER))')} AS sparsity FROM weights GROUP BY 1"))
def sparsity(spark, sf):
    return round_columns(interpret.sparsity(fx.weights(spark, sf), ["component"], 0.02), "sparsity")


@register("gene_weight_rollup", sql("weights", f"SELECT component, gene, {r6('sqrt(sum(weight * weight))')} AS l2, {r6('avg(abs(weight))')} AS mean_abs FROM weights GROUP BY 1, 2"))
def gene_weight_rollup(spark, sf):
    return round_columns(interpret.gene_weight_rollup(fx.weights(spark, sf), keys=["component"]), "l2", "mean_abs")


@register("topk_features", sql("weights", f"SELECT component, position, feature, {r6('weight')} AS weight, CAST(rank AS INTEGER) AS rank FROM ({_TOP.format(k=10)})"))
def topk_features(spark, sf):
    return round_columns(interpret.topk_features(fx.weights(spark, sf), ["component"], 10).drop("gene"), "weight")


@register(
    "topk_overlap",
    sql(
        "weights",
        "SELECT count(*) AS n_overlap, coalesce(string_agg(feature, ',' ORDER BY feature), '') AS members FROM (SELECT feature FROM t WHERE component = 0 INTERSECT SELECT feature FROM t WHERE component = 1)",
        t=_TOP.format(k=20),
    ),
)
def topk_overlap(spark, sf):
    w = fx.weights(spark, sf)
    return interpret.topk_overlap(w.filter("component = 0"), w.filter("component = 1"), 20)


_EDGE_W = (
    "SELECT roi_i, roi_j, avg(value) AS weight FROM (SELECT a.roi AS roi_i, b.roi AS roi_j, (a.value - b.value) / 100 AS value FROM ts AS a JOIN ts AS b ON a.subject_id = b.subject_id AND a.t = b.t AND a.roi < b.roi) GROUP BY 1, 2"
)


def _edge_weights(spark, sf):
    """Mean difference of two regions over all time points, from one vector per time point."""
    v = connectivity.timeseries_vectors(fx.ts(spark, sf))
    pairs = F.array(*[F.struct(F.lit(i).alias("roi_i"), F.lit(j).alias("roi_j"), ((F.col("values")[i] - F.col("values")[j]) / 100).alias("d")) for i in range(5) for j in range(i + 1, 5)])
    return v.select(F.inline(pairs)).groupBy("roi_i", "roi_j").agg(F.avg("d").alias("weight"))


_NODES = "SELECT node, w AS weight, w / (sum(w) OVER () + 1e-10) AS weight_norm FROM (SELECT node, sum(abs(weight)) AS w FROM (SELECT roi_i AS node, weight FROM e UNION ALL SELECT roi_j, weight FROM e) GROUP BY node)"


@register("edge_to_node", sql("ts", f"SELECT node, {r6('weight')} AS weight, {r6('weight_norm')} AS weight_norm FROM ({_NODES})", e=_EDGE_W))
def edge_to_node(spark, sf):
    return round_columns(interpret.edge_to_node(_edge_weights(spark, sf)), "weight", "weight_norm")


_RANKED = f"SELECT *, row_number() OVER (ORDER BY weight DESC, node) AS rank FROM ({_NODES})"


@register("rank_nodes", sql("ts", f"SELECT node, {r6('weight')} AS weight, {r6('weight_norm')} AS weight_norm, CAST(rank AS INTEGER) AS rank FROM ({_RANKED})", e=_EDGE_W))
def rank_nodes(spark, sf):
    return round_columns(interpret.rank_nodes(interpret.edge_to_node(_edge_weights(spark, sf))), "weight", "weight_norm")


@register("node_weight_report", sql("ts", f"SELECT node, {r6('weight')} AS weight, {r6('weight_norm')} AS weight_norm, CAST(rank AS INTEGER) AS rank FROM ({_RANKED})", e=_EDGE_W))
def node_weight_report(spark, sf):
    return round_columns(export.node_weight_report(_edge_weights(spark, sf)), "weight", "weight_norm")


@register(
    "category_rollup",
    sql(
        "ts",
        f"SELECT category, {r6('sum(weight)')} AS total_weight, {r6('sum(weight_norm)')} AS total_weight_norm, count(*) AS n_rois, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks, {r6('avg(rank)')} AS mean_rank "
        "FROM (SELECT *, CASE WHEN node < 2 THEN 'A' WHEN node < 4 THEN 'B' ELSE 'C' END AS category FROM r) GROUP BY 1",
        e=_EDGE_W,
        r=_RANKED,
    ),
)
def category_rollup(spark, sf):
    ranked = interpret.rank_nodes(interpret.edge_to_node(_edge_weights(spark, sf)))
    categories = ranked.select(F.col("node").alias("roi"), F.when(F.col("node") < 2, "A").when(F.col("node") < 4, "B").otherwise("C").alias("category"))
    got = interpret.category_rollup(ranked, categories).withColumn("ranks", F.array_join("ranks", ","))
    return round_columns(got, "total_weight", "total_weight_norm", "mean_rank")


@register(
    "cosine_similarity",
    sql(
        "weights",
        f"SELECT {r6('sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))')} AS cosine FROM (SELECT coalesce(x.weight, 0) AS a, coalesce(y.weight, 0) AS b FROM "
        "(SELECT * FROM weights WHERE component = 0 AND position < 50) AS x FULL JOIN (SELECT * FROM weights WHERE component = 1 AND position >= 10) AS y USING (feature))",
    ),
)
def cosine_similarity(spark, sf):
    w = fx.weights(spark, sf)
    a, b = w.filter("component = 0 and position < 50"), w.filter("component = 1 and position >= 10")
    return round_columns(interpret.cosine_similarity(a, b, ["feature"]), "cosine")


@register(
    "weight_profile",
    sql(
        "weights",
        f"SELECT component, count(*) AS n, {r6('avg(weight)')} AS mean, {r6('stddev_pop(weight)')} AS std, {r6('max(abs(weight))')} AS max_abs, count(*) FILTER (WHERE abs(weight) > 0.01) AS n_active, {r6('avg(CAST(abs(weight) < 0.02 AS INTEGER))')} AS sparsity FROM weights GROUP BY 1",
    ),
)
def weight_profile(spark, sf):
    return round_columns(interpret.weight_profile(fx.weights(spark, sf), ["component"], tol=0.02), "mean", "std", "max_abs", "sparsity")


@register("weight_correlation", sql("weights", f"SELECT count(*) AS n, {r6('corr(x.weight, y.weight)')} AS r FROM weights AS x JOIN weights AS y USING (feature) WHERE x.component = 0 AND y.component = 1"))
def weight_correlation(spark, sf):
    w = fx.weights(spark, sf)
    return round_columns(interpret.weight_correlation(w.filter("component = 0"), w.filter("component = 1"), ["feature"]), "r")


@register(
    "known_gene_ranks",
    sql(
        "weights",
        "SELECT grp, gene, CASE WHEN rank <= 20 THEN CAST(rank AS INTEGER) END AS rank, CASE WHEN rank <= 20 THEN CAST(rank AS VARCHAR) ELSE 'outside top 20' END AS note FROM "
        "(SELECT component AS grp, feature AS gene, row_number() OVER (PARTITION BY component ORDER BY abs(weight) DESC, feature) AS rank FROM weights WHERE component < 2) WHERE gene IN ('f00', 'f07', 'f33', 'f61')",
    ),
)
def known_gene_ranks(spark, sf):
    w = fx.weights(spark, sf).filter("component < 2").select(F.col("component").alias("grp"), F.col("feature").alias("gene"), "weight")
    wanted = w.select("gene").distinct().filter(F.col("gene").isin("f00", "f07", "f33", "f61"))
    return interpret.known_gene_ranks(wanted, w)


@register(
    "feature_component_grid",
    sql(
        "weights",
        "SELECT feature, " + ", ".join(r6(f"coalesce(max(weight) FILTER (WHERE component = {c}), 0)") + f" AS cc{c}" for c in range(5))
        + " FROM t WHERE feature IN (SELECT DISTINCT feature FROM t ORDER BY feature LIMIT 15) GROUP BY feature",
        t=f"SELECT * FROM ({_TOP.format(k=10)}) WHERE component < 5",
    ),
)
def feature_component_grid(spark, sf):
    got = interpret.feature_component_grid(fx.weights(spark, sf), [0, 1, 2, 3, 4])
    return round_columns(got, *[f"cc{c}" for c in range(5)])


@register(
    "l1_project",
    sql(
        "weights",
        f"SELECT component, feature, {r6('sign(weight) * t / sqrt(sum(t * t) OVER (PARTITION BY component))')} AS projected FROM "
        "(SELECT component, feature, weight, greatest(abs(weight) - CASE WHEN total > 1.5 THEN lam ELSE 0 END, 0) AS t FROM s JOIN l USING (component))",
        o="SELECT *, sum(abs(weight)) OVER (PARTITION BY component ORDER BY abs(weight) DESC, position ROWS UNBOUNDED PRECEDING) AS cs, row_number() OVER (PARTITION BY component ORDER BY abs(weight) DESC, position) AS k FROM weights",
        l="SELECT component, max((cs - 1.5) / k) FILTER (WHERE abs(weight) > (cs - 1.5) / k) AS lam, sum(abs(weight)) AS total FROM o GROUP BY component",
        s="SELECT component, feature, weight FROM weights",
    ),
)
def l1_project(spark, sf):
    got = interpret.l1_project(fx.weights(spark, sf), 1.5, ["component"])
    return round_columns(got.select("component", "feature", "projected"), "projected")


@register(
    "map_back_weights",
    sql(
        "weights",
        f"SELECT l.feature, CAST(w.component AS INTEGER) AS component, {r6('sum(l.weight * w.weight)')} AS weight FROM weights AS l JOIN "
        "(SELECT position AS pc, component, weight FROM weights) AS w ON l.component = w.pc GROUP BY 1, 2",
    ),
)
def map_back_weights(spark, sf):
    w = fx.weights(spark, sf)
    comps = w.select("feature", F.col("component").alias("pc"), F.col("weight").alias("loading"))
    small = w.select(F.col("position").alias("pc"), "component", "weight")
    return round_columns(interpret.map_back_weights(comps, small), "weight")
