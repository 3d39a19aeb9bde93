"""Time series, correlation edges and quality control on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.catalog import fixtures as fx
from pairlens.catalog.fixtures import r6, round_columns, sql
from pairlens.catalog.registry import register
from pairlens.operators import connectivity, qc

_Z = "CASE WHEN s > 0 AND lo < hi THEN (value - m) / s ELSE 0.0 END"
_ZS = (
    f"SELECT subject_id, t, roi, lo < hi AS ok, {_Z} AS z FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, min(value) OVER w AS lo, max(value) OVER w AS hi "
    "FROM ts WINDOW w AS (PARTITION BY subject_id, roi))"
)
_CLIP = "CASE WHEN {r} IS NOT NULL THEN atanh(greatest(-0.999999, least(0.999999, {r}))) END"
_PAIR = "FROM zs AS a JOIN zs AS b ON a.subject_id = b.subject_id AND a.t = b.t AND a.roi < b.roi GROUP BY a.subject_id, a.roi, b.roi"


def _edge_sql(r: str, where: str = "") -> str:
    return sql(
        "ts",
        f"SELECT subject_id, roi_i, roi_j, {r6(_CLIP.format(r=r))} AS z FROM p {where}",
        zs=_ZS,
        p=f"SELECT a.subject_id AS subject_id, a.roi AS roi_i, b.roi AS roi_j, count(*) AS n, CASE WHEN bool_and(a.ok AND b.ok) THEN sum(a.z * b.z) / count(*) END AS r, sum(a.z * b.z) AS dot {_PAIR}",
    )


@register("zscore_over_time", sql("ts", f"SELECT subject_id, t, roi, {r6('z')} AS z FROM zs", zs=_ZS))
def zscore_over_time(spark, sf):
    return round_columns(connectivity.zscore_over_time(fx.ts(spark, sf)), "z")


@register("fc_edges", _edge_sql("r"))
def fc_edges(spark, sf):
    return round_columns(connectivity.fc_edges(fx.ts(spark, sf)), "z")


@register("fc_edges_dot", _edge_sql("dot / greatest(n - 1, 1)"))
def fc_edges_dot(spark, sf):
    return round_columns(connectivity.fc_edges(fx.ts(spark, sf), denominator="n-1"), "z")


@register("fc_edges_zero", _edge_sql("coalesce(r, 0.0)"))
def fc_edges_zero(spark, sf):
    return round_columns(connectivity.fc_edges(fx.ts(spark, sf), nan="zero"), "z")


@register("fc_edges_drop", _edge_sql("r", "WHERE subject_id NOT IN (SELECT subject_id FROM p WHERE r IS NULL)"))
def fc_edges_drop(spark, sf):
    return round_columns(connectivity.fc_edges(fx.ts(spark, sf), nan="drop"), "z")


@register("fc_edges_strict", _edge_sql("r"))
def fc_edges_strict(spark, sf):
    series = fx.ts(spark, sf)
    return round_columns(connectivity.fc_edges(series, required=fx.dup(spark, sf).select("subject_id").distinct()), "z")


@register("fc_edges_from_files", _edge_sql("r"))
def fc_edges_from_files(spark, sf):
    """The same edges from one array file per subject, decoded to one vector per time point."""
    from pairlens.catalog.inputs import series_files
    from pairlens.sources.arrays import timeseries_vector_rows

    vectors = timeseries_vector_rows(series_files(spark, sf, "/roi/{sid}/atlas.npy"), id_rule="folder")
    return round_columns(connectivity.fc_edges_of_vectors(vectors), "z")


@register("fc_edges_complete", _edge_sql("r", "WHERE CAST(subject_id AS BIGINT) % 7 <> 0"))
def fc_edges_complete(spark, sf):
    """Subjects that lack a region (here those with a switched-off type 4) are left out."""
    partial = fx.ts(spark, sf).filter(~((F.col("roi") == 4) & (F.col("subject_id").cast("long") % 7 == 0)))
    return round_columns(connectivity.fc_edges(partial, n_rois=5), "z")


@register(
    "pair_rois",
    sql("ts", "SELECT a.subject_id, a.roi AS roi_i, b.roi AS roi_j, CAST(a.roi * 5 - a.roi * (a.roi + 1) // 2 + (b.roi - a.roi - 1) AS BIGINT) AS edge FROM d AS a JOIN d AS b ON a.subject_id = b.subject_id AND a.roi < b.roi",
        d="SELECT DISTINCT subject_id, roi FROM ts"),
)
def pair_rois(spark, sf):
    edges = connectivity.fc_edges(fx.ts(spark, sf))
    return connectivity.with_edge_ordinal(edges, 5).drop("z")


@register(
    "edge_vectors",
    sql(
        "ts",
        f"SELECT subject_id, count(*) AS width, {r6('sum(z * (edge + 1))')} AS weighted FROM v GROUP BY subject_id",
        zs=_ZS,
        p=f"SELECT a.subject_id AS subject_id, a.roi AS i, b.roi AS j, CASE WHEN bool_and(a.ok AND b.ok) THEN sum(a.z * b.z) / count(*) ELSE 0 END AS r {_PAIR}",
        v=f"SELECT subject_id, i * 5 - i * (i + 1) // 2 + (j - i - 1) AS edge, {_CLIP.format(r='r')} AS z FROM p",
    ),
)
def edge_vectors(spark, sf):
    vectors = connectivity.edge_vectors(connectivity.fc_edges(fx.ts(spark, sf), nan="zero"))
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return round_columns(vectors.select("subject_id", F.size("features").cast("long").alias("width"), weighted.alias("weighted")), "weighted")


@register("roi_count_mismatch", "SELECT CAST(user_id AS VARCHAR) AS subject_id, count(DISTINCT event_type) AS n_rois FROM events GROUP BY user_id HAVING count(DISTINCT event_type) <> 5")
def roi_count_mismatch(spark, sf):
    types = F.array(*[F.lit(t) for t in fx.EVENT_TYPES])
    raw = fx.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("subject_id"), (F.array_position(types, F.col("event_type")) - 1).cast("int").alias("roi")
    )
    return connectivity.roi_count_mismatch(raw, 5)


def _groups(spark, sf):
    """Two regions to A, two to B, the last to C, for the event types present."""
    types = F.array(*[F.lit(t) for t in fx.EVENT_TYPES])
    roi = (F.array_position(types, F.col("event_type")) - 1).cast("int")
    return fx.table(spark, sf, "events").select(roi.alias("roi")).distinct().withColumn(
        "grp", F.when(F.col("roi") < 2, "A").when(F.col("roi") < 4, "B").otherwise("C")
    )


_GROUP = "CASE WHEN roi < 2 THEN 'A' WHEN roi < 4 THEN 'B' ELSE 'C' END"


@register(
    "network_fc",
    sql(
        "ts",
        f"SELECT subject_id, group_i, group_j, {r6(_CLIP.format(r='r'))} AS z FROM p",
        zs=_ZS,
        g=f"SELECT subject_id, t, {_GROUP} AS grp, avg(z) AS v FROM zs GROUP BY 1, 2, 3",
        p="SELECT a.subject_id AS subject_id, a.grp AS group_i, b.grp AS group_j, CASE WHEN stddev_pop(a.v) > 1e-9 AND stddev_pop(b.v) > 1e-9 THEN corr(a.v, b.v) END AS r "
        "FROM g AS a JOIN g AS b ON a.subject_id = b.subject_id AND a.t = b.t AND a.grp < b.grp GROUP BY 1, 2, 3",
    ),
)
def network_fc(spark, sf):
    cov = connectivity.roi_covariance(connectivity.timeseries_vectors(fx.ts(spark, sf)))
    got = connectivity.network_fc(cov, _groups(spark, sf).withColumnRenamed("grp", "network"))
    return round_columns(got, "z")


@register(
    "group_fc_qc",
    sql(
        "ts",
        f"SELECT subject_id, group_i, group_j, {r6(_CLIP.format(r='r'))} AS z FROM p WHERE subject_id NOT IN (SELECT subject_id FROM p WHERE r IS NULL)",
        sd="SELECT subject_id, roi, CASE WHEN min(value) < max(value) THEN stddev_pop(value) ELSE 0 END AS s FROM ts GROUP BY 1, 2",
        rate="SELECT roi FROM sd GROUP BY roi HAVING avg(CAST(s > 20 AS INTEGER)) >= 0.1",
        flags=f"SELECT subject_id, roi, {_GROUP} AS grp, s > 20 AS valid FROM sd WHERE roi IN (SELECT roi FROM rate)",
        ok="SELECT subject_id FROM (SELECT subject_id, grp, avg(CAST(valid AS INTEGER)) AS share FROM flags GROUP BY 1, 2) GROUP BY 1 HAVING min(share) >= 0.5",
        g="SELECT ts.subject_id AS subject_id, t, grp, avg(value) AS v FROM ts JOIN flags ON ts.subject_id = flags.subject_id AND ts.roi = flags.roi "
        "WHERE valid AND ts.subject_id IN (SELECT subject_id FROM ok) GROUP BY 1, 2, 3",
        p="SELECT a.subject_id AS subject_id, a.grp AS group_i, b.grp AS group_j, CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN corr(a.v, b.v) END AS r "
        "FROM g AS a JOIN g AS b ON a.subject_id = b.subject_id AND a.t = b.t AND a.grp < b.grp GROUP BY 1, 2, 3",
    ),
)
def group_fc_qc(spark, sf):
    series = fx.ts(spark, sf)
    kept = qc.kept_rois(qc.validity_flags(series, 20), 0.1)
    cov = connectivity.roi_covariance(connectivity.timeseries_vectors(series))
    return round_columns(connectivity.group_fc_qc(cov, _groups(spark, sf), kept, std_threshold=20, min_fraction=0.5), "z")


# ---- quality control ----------------------------------------------------------------

_FLAGS = "SELECT subject_id, roi, CASE WHEN min(value) < max(value) THEN stddev_pop(value) ELSE 0 END AS sd FROM ts GROUP BY 1, 2"
_VALID = f"SELECT subject_id, roi, sd, sd > 20 AS valid FROM ({_FLAGS})"


def _flags(spark, sf):
    return qc.validity_flags(fx.ts(spark, sf), 20)


@register("validity_flags", sql("ts", f"SELECT subject_id, roi, {r6('sd')} AS sd, valid FROM ({_VALID})"))
def validity_flags(spark, sf):
    return round_columns(_flags(spark, sf), "sd")


@register(
    "roi_qc",
    sql(
        "ts",
        "SELECT * FROM (SELECT count(*) AS n_rois_input, count(*) FILTER (WHERE r >= 0.2) AS n_rois_kept, "
        f"{r6('min(r)')} AS roi_valid_rate_min, {r6('median(r)')} AS roi_valid_rate_median, {r6('max(r)')} AS roi_valid_rate_max FROM rates), "
        f"(SELECT count(*) AS n_subjects_input, count(*) FILTER (WHERE i <= 0.5) AS n_subjects_kept, {r6('min(i)')} AS subject_invalid_rate_min, "
        f"{r6('median(i)')} AS subject_invalid_rate_median, {r6('max(i)')} AS subject_invalid_rate_max FROM inv)",
        f=_VALID,
        rates="SELECT roi, avg(CAST(valid AS INTEGER)) AS r FROM f GROUP BY roi",
        inv="SELECT subject_id, 1 - avg(CAST(valid AS INTEGER)) AS i FROM f WHERE roi IN (SELECT roi FROM rates WHERE r >= 0.2) GROUP BY 1",
    ),
)
def roi_qc(spark, sf):
    got = qc.roi_qc(_flags(spark, sf), 0.2, 0.5)
    rates = [c for c in got.columns if "rate" in c]
    return round_columns(got, *rates)


@register("roi_valid_rates", sql("ts", f"SELECT roi, {r6('avg(CAST(valid AS INTEGER))')} AS valid_rate FROM f GROUP BY roi", f=_VALID))
def roi_valid_rates(spark, sf):
    return round_columns(qc.roi_valid_rates(_flags(spark, sf)).orderBy(F.col("valid_rate").desc(), "roi"), "valid_rate")


@register(
    "roi_qc_lists",
    sql(
        "ts",
        f"SELECT 'roi' AS kind, CAST(roi AS VARCHAR) AS name, {r6('r')} AS rate FROM rates WHERE r >= 0.2 UNION ALL SELECT 'subject', subject_id, {r6('i')} FROM inv WHERE i <= 0.5",
        f=_VALID,
        rates="SELECT roi, avg(CAST(valid AS INTEGER)) AS r FROM f GROUP BY roi",
        inv="SELECT subject_id, 1 - avg(CAST(valid AS INTEGER)) AS i FROM f WHERE roi IN (SELECT roi FROM rates WHERE r >= 0.2) GROUP BY 1",
    ),
)
def roi_qc_lists(spark, sf):
    flags = _flags(spark, sf)
    rois = qc.kept_rois(flags, 0.2)
    subjects = qc.kept_subjects(flags, rois, 0.5)
    a = rois.select(F.lit("roi").alias("kind"), F.col("roi").cast("string").alias("name"), F.col("valid_rate").alias("rate"))
    b = subjects.select(F.lit("subject").alias("kind"), F.col("subject_id").alias("name"), F.col("invalid_rate").alias("rate"))
    return round_columns(a.unionByName(b), "rate")


@register(
    "subject_health",
    sql(
        "ts",
        "SELECT count(*) AS n_subjects, count(*) FILTER (WHERE n = 0) AS n_all_zero, count(*) FILTER (WHERE n >= 2) AS n_enough, min(n) AS valid_min, "
        f"{r6('median(n)')} AS valid_median, {r6('avg(n)')} AS valid_mean, max(n) AS valid_max FROM (SELECT subject_id, count(*) FILTER (WHERE valid) AS n FROM f GROUP BY 1)",
        f=_VALID,
    ),
)
def subject_health(spark, sf):
    return round_columns(qc.subject_health(_flags(spark, sf), 2), "valid_median", "valid_mean")


@register("sort_by_valid_count", sql("ts", "SELECT subject_id, count(*) FILTER (WHERE valid) AS n_valid FROM f GROUP BY 1", f=_VALID))
def sort_by_valid_count(spark, sf):
    return qc.sort_by_valid_count(_flags(spark, sf))


@register(
    "qc_extremes",
    sql(
        "ts",
        f"SELECT kind, name, {r6('rate')} AS rate FROM ((SELECT 'lowest_roi' AS kind, CAST(roi AS VARCHAR) AS name, avg(CAST(valid AS INTEGER)) AS rate FROM f GROUP BY roi ORDER BY rate, roi LIMIT 3) "
        "UNION ALL (SELECT 'best_subject', subject_id, i FROM inv ORDER BY i, subject_id LIMIT 3) UNION ALL (SELECT 'worst_subject', subject_id, i FROM inv ORDER BY i DESC, subject_id LIMIT 3))",
        f=_VALID,
        inv="SELECT subject_id, 1 - avg(CAST(valid AS INTEGER)) AS i FROM f GROUP BY 1",
    ),
)
def qc_extremes(spark, sf):
    return round_columns(qc.qc_extremes(_flags(spark, sf), n_rois=3), "rate")


_VOX = "SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, l_linenumber AS voxel, CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE l_quantity END AS value FROM lineitem"
_OVERLAP = f"SELECT subject_id, count(*) AS n_voxels, avg(CAST(value <> 0 AS INTEGER)) AS overlap FROM ({_VOX}) WHERE voxel <= 3 GROUP BY 1"


def _voxels(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("subject_id"), F.col("l_linenumber").alias("voxel"),
        F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_quantity")).alias("value"),
    )


def _atlas(spark, sf):
    return fx.table(spark, sf, "lineitem").filter("l_linenumber <= 3").select(F.col("l_linenumber").alias("voxel")).distinct()


def _overlap(spark, sf):
    return qc.atlas_overlap(_voxels(spark, sf), _atlas(spark, sf))


@register("atlas_overlap", f"SELECT subject_id, n_voxels, {r6('overlap')} AS overlap FROM ({_OVERLAP})")
def atlas_overlap(spark, sf):
    return round_columns(_overlap(spark, sf), "overlap")


_STATUS = (
    f"SELECT subject_id, CASE WHEN overlap IS NULL THEN 'missing' WHEN overlap = 0 THEN 'zero_overlap' ELSE 'ok' END AS status FROM (SELECT CAST(o_orderkey AS VARCHAR) AS subject_id FROM orders) LEFT JOIN ({_OVERLAP}) USING (subject_id)"
)


def _status(spark, sf):
    wanted = fx.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("subject_id"))
    return qc.status_flags(wanted, _overlap(spark, sf)).select("subject_id", "status")


@register("status_flags", _STATUS)
def status_flags(spark, sf):
    return _status(spark, sf)


@register(
    "qc_flow",
    sql(
        "ts",
        "SELECT status, count(*) AS n, count(*) FILTER (WHERE nv = 0) AS n_all_zero, count(*) FILTER (WHERE nv > 0) AS n_with_signal, count(*) FILTER (WHERE nv IS NULL) AS n_without_series FROM st LEFT JOIN h USING (subject_id) GROUP BY 1",
        f=_VALID,
        h="SELECT subject_id, count(*) FILTER (WHERE valid) AS nv FROM f GROUP BY 1",
        st=_STATUS,
    ),
)
def qc_flow(spark, sf):
    health = _flags(spark, sf).groupBy("subject_id").agg(F.count_if("valid").alias("n_valid"))
    return qc.qc_flow(_status(spark, sf), health)


@register(
    "overlap_histogram",
    sql(
        "",
        "SELECT CAST(b.b AS INTEGER) AS bin, count(x.bin) AS n FROM range(30) AS b(b) LEFT JOIN x ON x.bin = b.b GROUP BY 1",
        o=_OVERLAP,
        lim="SELECT min(overlap) AS lo, max(overlap) AS hi FROM o",
        x="SELECT least(floor((overlap - lo) * 30 / (hi - lo)), 29) AS bin FROM o, lim",
    ),
)
def overlap_histogram(spark, sf):
    return qc.overlap_histogram(_overlap(spark, sf))


@register(
    "table_profile",
    sql(
        "tab",
        "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_features, count(*) FILTER (WHERE CAST(subject_id AS BIGINT) % 17 = 0) AS n_nan, CAST(0 AS BIGINT) AS n_inf, "
        f"{r6('least(min(f0), min(f1) FILTER (WHERE CAST(subject_id AS BIGINT) % 17 <> 0), min(f2), min(f3), min(f4), min(f5))')} AS min_value, "
        f"{r6('greatest(max(f0), max(f1) FILTER (WHERE CAST(subject_id AS BIGINT) % 17 <> 0), max(f2), max(f3), max(f4), max(f5))')} AS max_value FROM tab",
    ),
)
def table_profile(spark, sf):
    return round_columns(qc.table_profile(fx.tab_nan(spark, sf)), "min_value", "max_value")


@register("imbalance_flag", sql("line_scores", f"SELECT count(*) AS n, {r6('avg(y)')} AS prevalence, CASE WHEN avg(y) < 0.2 OR avg(y) > 0.8 THEN 'ap' ELSE 'auc' END AS preferred_metric FROM line_scores"))
def imbalance_flag(spark, sf):
    return round_columns(qc.imbalance_flag(fx.line_scores(spark, sf)), "prevalence")
