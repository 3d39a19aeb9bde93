"""Joins, id sets, duplicates, splits and orderings on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.catalog.fixtures import r6, round_columns, sql
from pairlens.catalog.registry import register
from pairlens.operators import align, ranking, reports, splits

_FIRST = "SELECT subject_id, pos, value, kind FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY pos) AS rn FROM dup) WHERE rn = 1"
_LAST = _FIRST.replace("ORDER BY pos", "ORDER BY pos DESC")


@register("keep_first", sql("dup", _FIRST))
def keep_first(spark, sf):
    return ranking.keep_first(fx.dup(spark, sf), "subject_id", "pos")


@register("keep_last", sql("dup", _LAST))
def keep_last(spark, sf):
    return ranking.keep_last(fx.dup(spark, sf), "subject_id", "pos")


@register(
    "align_two",
    sql("dup emb", f"SELECT f.subject_id, f.value, e.label FROM ({_FIRST}) AS f JOIN emb AS e USING (subject_id)"),
)
def align_two(spark, sf):
    events = fx.dup(spark, sf).drop("kind")
    vectors = fx.emb(spark, sf).select("subject_id", "label", F.lit(0).alias("pos"))
    return align.align_two(events, vectors, position="pos", keep="first")


@register(
    "align_three_last",
    sql("dup emb tab", f"SELECT f.subject_id, f.value, {r6('t.f0')} AS f0, e.y FROM ({_LAST}) AS f JOIN tab AS t USING (subject_id) JOIN emb AS e USING (subject_id)"),
)
def align_three_last(spark, sf):
    events = fx.dup(spark, sf).drop("kind")
    tab = fx.tab(spark, sf).select("subject_id", F.col("features")[0].alias("f0"), F.lit(0).alias("pos"))
    labels = fx.emb(spark, sf).select("subject_id", "y", F.lit(0).alias("pos"))
    return round_columns(align.align_three(events, tab, labels, position="pos", keep="last"), "f0")


@register("attach_covariates", sql("emb cov", "SELECT subject_id, y, age, sex FROM emb JOIN cov USING (subject_id) WHERE valid"))
def attach_covariates(spark, sf):
    return align.attach_covariates(fx.emb(spark, sf).select("subject_id", "y"), fx.cov(spark, sf))


@register("attach_labels", sql("emb tab", f"SELECT subject_id, {r6('f0')} AS f0, y FROM tab JOIN emb USING (subject_id)"))
def attach_labels(spark, sf):
    rows = fx.tab(spark, sf).select("subject_id", F.col("features")[0].alias("f0"))
    return round_columns(align.attach_labels(rows, fx.emb(spark, sf).select("subject_id", "y")), "f0")


_WANTED = "SELECT CAST(o_custkey AS VARCHAR) AS subject_id, min(o_orderkey) AS pos FROM orders GROUP BY o_custkey"


def _wanted(spark, sf):
    return fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("subject_id")).agg(F.min("o_orderkey").alias("pos"))


@register("take_in_order", sql("cov", f"SELECT subject_id, pos, age FROM ({_WANTED}) JOIN cov USING (subject_id)"))
def take_in_order(spark, sf):
    return align.take_in_order(_wanted(spark, sf), fx.cov(spark, sf).select("subject_id", "age"))


@register("subset_by_ids", sql("emb", "SELECT subject_id, CAST(vec_id AS BIGINT) AS pos, e.label FROM embeddings JOIN emb AS e ON e.subject_id = CAST(vec_id AS VARCHAR) WHERE embeddings.label >= 5"))
def subset_by_ids(spark, sf):
    ids = fx.emb(spark, sf).filter("label >= 5").select("subject_id", F.col("subject_id").cast("long").alias("pos"))
    return align.subset_by_ids(ids, fx.emb(spark, sf).select("subject_id", "label"))


@register("reorder_or_align", sql("emb", "SELECT subject_id, -CAST(subject_id AS BIGINT) AS pos, y FROM emb"))
def reorder_or_align(spark, sf):
    ids = fx.emb(spark, sf).select("subject_id", (-F.col("subject_id").cast("long")).alias("pos"))
    return align.reorder_or_align(ids, fx.emb(spark, sf).select("subject_id", "y"))


@register("semi_available", sql("emb dup", "SELECT subject_id, label FROM emb WHERE subject_id IN (SELECT subject_id FROM dup)"))
def semi_available(spark, sf):
    return align.semi_available(fx.emb(spark, sf).select("subject_id", "label"), fx.dup(spark, sf))


@register("limit_subjects", sql("dup", "SELECT subject_id, pos, value FROM dup WHERE subject_id IN (SELECT DISTINCT subject_id FROM dup ORDER BY subject_id LIMIT 10)"))
def limit_subjects(spark, sf):
    return align.limit_subjects(fx.dup(spark, sf).drop("kind"), 10)


@register(
    "join_tabular",
    sql("emb tab cov", f"SELECT subject_id, CAST(70 AS INTEGER) AS width, {r6('list_sum(list_transform(list_concat(CAST(embedding AS DOUBLE[]), [f0, f1, f2, f3, f4, f5]), lambda x, i: x * i))')} AS weighted, age, sex FROM emb JOIN tab USING (subject_id) JOIN cov USING (subject_id) WHERE valid"),
)
def join_tabular(spark, sf):
    a = fx.emb(spark, sf).select("subject_id", F.col("embedding").cast("array<double>").alias("features"))
    got = align.join_tabular(a, fx.tab(spark, sf), align.apply_valid_mask(fx.cov(spark, sf)))
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return round_columns(got.select("subject_id", F.size("features").alias("width"), weighted.alias("weighted"), "age", "sex"), "weighted")


@register(
    "attach_feature_names",
    "SELECT p_partkey, p_brand AS \"column\", CASE WHEN d.b IS NULL THEN p_brand WHEN d.n % 2 = 0 THEN 'even: ' || d.t ELSE d.t END AS name, d.b IS NULL AS is_missing FROM part "
    "LEFT JOIN (SELECT p_brand AS b, min(p_type) AS t, count(*) AS n FROM part GROUP BY 1 HAVING p_brand <> 'Brand#11') AS d ON p_brand = d.b",
)
def attach_feature_names(spark, sf):
    p = fx.table(spark, sf, "part")
    dictionary = p.filter("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("column")).agg(
        F.min("p_type").alias("description"), F.when(F.count(F.lit(1)) % 2 == 0, "even").otherwise("").alias("category")
    )
    return align.attach_feature_names(p.select("p_partkey", F.col("p_brand").alias("column")), dictionary)


@register(
    "ids_intersect",
    sql("emb dup cov", "SELECT subject_id FROM emb INTERSECT SELECT subject_id FROM dup INTERSECT SELECT subject_id FROM cov WHERE valid"),
)
def ids_intersect(spark, sf):
    return align.ids_intersect(
        fx.emb(spark, sf).select("subject_id"), fx.dup(spark, sf).select("subject_id"), align.apply_valid_mask(fx.cov(spark, sf)).select("subject_id")
    )


@register("ids_missing", sql("emb dup", "SELECT subject_id FROM emb EXCEPT SELECT subject_id FROM dup"))
def ids_missing(spark, sf):
    return align.ids_missing(fx.emb(spark, sf), fx.dup(spark, sf))


@register(
    "union_results",
    sql("strat", f"SELECT model, modality, {r6('r_diff')} AS r_diff, NULL::DOUBLE AS p_value FROM strat WHERE modality = 'F' UNION ALL SELECT model, modality, NULL, {r6('p_value')} FROM strat WHERE modality = 'O'"),
)
def union_results(spark, sf):
    s = fx.strat(spark, sf)
    got = reports.union_results(s.filter("modality = 'F'").select("model", "modality", "r_diff"), s.filter("modality = 'O'").select("modality", "model", "p_value"))
    return round_columns(got, "r_diff", "p_value")


# ---- splits -----------------------------------------------------------------------



@register(
    "stratified_holdout",
    sql(
        "emb",
        "SELECT subject_id, y, CASE WHEN rn <= quota THEN 'holdout' ELSE 'train' END AS split FROM ranked JOIN quota USING (y)",
        ranked="SELECT subject_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(subject_id || '|42'), subject_id) AS rn FROM emb",
        sizes="SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM emb GROUP BY y",
        shares="SELECT y, ceil(0.2 * total) * n / total AS share, ceil(0.2 * total) AS want FROM sizes",
        quota="SELECT y, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, y) <= want - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM shares",
    ),
)
def stratified_holdout(spark, sf):
    return splits.stratified_holdout(fx.emb(spark, sf).select("subject_id", "y"))


@register(
    "stratified_holdout_orders",
    sql(
        "",
        "SELECT split, y, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, y, CASE WHEN rn <= quota THEN 'holdout' ELSE 'train' END AS split FROM ranked JOIN quota USING (y)) GROUP BY 1, 2",
        base="SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders",
        ranked="SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7'), o_orderkey) AS rn FROM base",
        sizes="SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM base GROUP BY y",
        shares="SELECT y, ceil(0.25 * total) * n / total AS share, ceil(0.25 * total) AS want FROM sizes",
        quota="SELECT y, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, y) <= want - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM shares",
    ),
)
def stratified_holdout_orders(spark, sf):
    rows = fx.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    split = splits.stratified_holdout(rows, id_col="o_orderkey", fraction=0.25, seed=7)
    return split.groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@register(
    "shuffle_holdout",
    sql(
        "emb",
        "SELECT subject_id, y, CASE WHEN rn <= ceil(0.2 * n) THEN 'holdout' ELSE 'train' END AS split FROM (SELECT subject_id, y, "
        "row_number() OVER (PARTITION BY y ORDER BY md5(subject_id || '|42'), subject_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM emb)",
    ),
)
def shuffle_holdout(spark, sf):
    return splits.shuffle_holdout(fx.emb(spark, sf).select("subject_id", "y"), group="y")


@register(
    "shuffle_holdout_plain",
    sql(
        "emb",
        "SELECT subject_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'holdout' ELSE 'train' END AS split FROM (SELECT subject_id, "
        "row_number() OVER (ORDER BY md5(subject_id || '|42'), subject_id) AS rn, count(*) OVER () AS n FROM emb)",
    ),
)
def shuffle_holdout_plain(spark, sf):
    return splits.shuffle_holdout(fx.emb(spark, sf).select("subject_id"))


@register("stratified_kfold", sql("emb", "SELECT subject_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(subject_id || '|42'), subject_id) - 1) % 5 AS INTEGER) AS fold FROM emb"))
def stratified_kfold(spark, sf):
    return splits.stratified_kfold(fx.emb(spark, sf).select("subject_id", "y"))


@register("kfold", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|3'), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def kfold(spark, sf):
    return splits.kfold(fx.table(spark, sf, "orders").select("o_orderkey"), id_col="o_orderkey", seed=3)


@register("class_counts", "SELECT o_orderpriority AS split, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_case, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_control, " + r6("avg(CAST(o_orderstatus = 'F' AS INTEGER))") + " AS prevalence FROM orders GROUP BY 1")
def class_counts(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("split"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return round_columns(splits.class_counts(rows, ["split"]), "prevalence")


@register(
    "sort_custom_order",
    sql(
        "strat",
        "SELECT model, modality, CAST(CASE model WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 ELSE 2 END AS INTEGER) AS model_pos, CAST(CASE modality WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER) AS modality_pos FROM strat",
    ),
)
def sort_custom_order(spark, sf):
    s = align.sort_custom_order(fx.strat(spark, sf).select("model", "modality"), {"model": ["1-URGENT", "5-LOW"], "modality": ["P", "O"]})
    pos = [F.col(f"sort_pos.{c}").cast("int").alias(f"{c}_pos") for c in ("model", "modality")]
    return s.orderBy("sort_pos", "model").select("model", "modality", *pos)


@register(
    "hash_rank",
    "SELECT l_returnflag, l_orderkey, rn AS rank FROM (SELECT l_returnflag, l_orderkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '|1'), l_orderkey) AS rn "
    "FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem))",
)
def hash_rank(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    return ranking.hash_rank(rows, ["l_returnflag"], "l_orderkey", 1).withColumn("rank", F.col("rank").cast("long"))


@register(
    "running_totals",
    "SELECT o_orderstatus, o_orderkey, CAST(coalesce(sum(c) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c_before FROM (SELECT o_orderstatus, o_orderkey, o_custkey AS c FROM orders)",
)
def running_totals(spark, sf):
    rows = fx.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.col("o_custkey").alias("c"))
    return ranking.running_totals(rows, ["o_orderstatus"], "o_orderkey", ["c"]).drop("c")
