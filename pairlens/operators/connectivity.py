"""Correlation-edge features from region time series.

Input is long (subject_id, t, roi, value) with regions numbered 0..R-1, or rows of
(subject_id, t, values[R]). Per-subject covariances come from the grouped second
moments, so time points of one subject may be spread over many tasks and no pair of
rows is ever joined. Edges between groups of regions follow from the region
covariances by averaging, without going back to the time series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.vectors import edge_ordinal, fisher_z
from pairlens.operators.moments import moments

TIME_BLOCK = 4096
CONSTANT_TOLERANCE = 1e-13  # variance below this share of the mean square counts as constant

NETWORK_17_TO_7 = {  # fixed values
    "VisCent": "Vis",
    "VisPeri": "Vis",
    "SomMotA": "SomMot",
    "SomMotB": "SomMot",
    "DorsAttnA": "DorsAttn",
    "DorsAttnB": "DorsAttn",
    "SalVentAttnA": "SalVentAttn",
    "SalVentAttnB": "SalVentAttn",
    "LimbicA": "Limbic",
    "LimbicB": "Limbic",
    "ContA": "Cont",
    "ContB": "Cont",
    "ContC": "Cont",
    "DefaultA": "Default",
    "DefaultB": "Default",
    "DefaultC": "Default",
    "TempPar": "Default",
}


def orient_timeseries(df: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Swap t and roi for subjects with fewer time points than regions."""
    shape = df.groupBy(subject).agg((F.max("t") < F.max("roi")).alias("_swap"))
    joined = df.join(shape, subject)
    return joined.select(
        subject,
        F.when(F.col("_swap"), F.col("roi")).otherwise(F.col("t")).alias("t"),
        F.when(F.col("_swap"), F.col("t")).otherwise(F.col("roi")).alias("roi"),
        "value",
    )


def timeseries_vectors(ts: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Long series to one row (subject, t, values[R]) per time point.

    Rows are placed by (subject, block of time points), so a subject normally stays in
    one task while a very long series is split; the aggregation reuses that placement.
    """
    # An explicit count keeps the numeric work parallel where the input is small in bytes.
    parts = int(ts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ts.withColumn("_tb", F.floor(F.col("t") / TIME_BLOCK)).repartition(parts, subject, "_tb")
    cells = F.array_sort(F.collect_list(F.struct(F.col("roi").alias("r"), F.col("value").cast("double").alias("v"))))
    complete = F.forall(F.transform("_c", lambda c, i: c["r"] == i), lambda ok: ok)
    message = F.concat(F.lit("a time point lacks a region: subject "), F.col(subject).cast("string"))
    values = F.when(complete, F.transform("_c", lambda c: c["v"])).otherwise(F.raise_error(message).cast("array<double>"))
    packed = placed.groupBy(subject, "_tb", "t").agg(cells.alias("_c"))
    # Sorted by subject, so the partial sums of a task finish one subject after the other.
    return packed.select(subject, "t", values.alias("values")).sortWithinPartitions(subject)


def roi_count_mismatch(ts: DataFrame, n_rois: int, subject: str = "subject_id") -> DataFrame:
    """Subjects whose series does not hold exactly the regions 0..n-1."""
    counts = ts.groupBy(subject).agg(F.countDistinct("roi").alias("n_rois"), F.max("roi").alias("_top"))
    return counts.filter((F.col("n_rois") != n_rois) | (F.col("_top") != n_rois - 1)).select(subject, "n_rois")


def roi_covariance(vectors: DataFrame, subject: str = "subject_id") -> DataFrame:
    """(subject, roi_i, roi_j, n_t, cov, var_i, var_j) for i <= j; variance 0 marks a constant region."""
    # The constant goes last, at index R: cells (i, R) are the sums, (R, R) is the count.
    z = F.concat("values", F.array(F.lit(1.0)))
    mom = moments(vectors.withColumn("_r", F.size("values")), [subject, "_r"], z, many_keys=True)
    # One subject has (R + 1)(R + 2) / 2 cells however long its series is.
    uneven = F.raise_error(F.concat(F.lit("time points of unequal width: subject "), F.col(subject).cast("string")))
    packed = mom.groupBy(subject).agg(
        F.when(F.min("_r") == F.max("_r"), F.max("_r")).otherwise(uneven.cast("int")).alias("_r"),
        F.collect_list(F.struct("i", "j", "s")).alias("_c"),
    )

    def ordered(cells: Column) -> Column:
        return F.transform(F.array_sort(cells), lambda c: c["s"])

    r = F.col("_r")
    stats = packed.select(
        subject,
        "_r",
        "_c",
        ordered(F.filter("_c", lambda c: c["j"] == r)).alias("_sum"),
        ordered(F.filter("_c", lambda c: c["i"] == c["j"])).alias("_sq"),
    ).withColumn("_n", F.element_at("_sum", -1))
    n = F.col("_n")

    def variance(i: Column) -> Column:
        mean, square = F.get("_sum", i) / n, F.get("_sq", i) / n
        var = square - mean * mean
        return F.when(var > CONSTANT_TOLERANCE * square, var).otherwise(0.0)

    with_var = stats.withColumn("_var", F.transform(F.sequence(F.lit(0), r - 1), variance))
    rows = F.transform(
        F.filter("_c", lambda c: c["j"] < r),
        lambda c: F.struct(
            c["i"].alias("roi_i"),
            c["j"].alias("roi_j"),
            n.cast("long").alias("n_t"),
            (c["s"] / n - F.get("_sum", c["i"]) / n * F.get("_sum", c["j"]) / n).alias("cov"),
            F.get("_var", c["i"]).alias("var_i"),
            F.get("_var", c["j"]).alias("var_j"),
        ),
    )
    return with_var.select(subject, F.inline(rows))


def correlation_edges(
    cov: DataFrame,
    subject: str = "subject_id",
    denominator: str = "n",
    nan: str = "null",
) -> DataFrame:
    """Fisher-z edges (subject, roi_i, roi_j, z), i < j, from covariances.

    `denominator="n-1"` gives the dot-product form z'z/(T-1), in which a constant region
    has correlation 0. `nan` decides about constant regions otherwise: null keeps NULL
    edges, zero writes 0, drop removes the whole subject.
    """
    edges = cov.filter("roi_i < roi_j")
    defined = (F.col("var_i") > 0) & (F.col("var_j") > 0)
    r = F.when(defined, F.col("cov") / F.sqrt(F.col("var_i") * F.col("var_j")))
    if denominator == "n-1":
        r = F.coalesce(r * F.col("n_t") / F.greatest(F.col("n_t") - 1, F.lit(1)), F.lit(0.0))
    elif nan == "zero":
        r = F.coalesce(r, F.lit(0.0))
    elif nan == "drop":
        bad = edges.filter(~defined).select(subject).distinct()
        edges = edges.join(bad, subject, "left_anti")
    elif nan != "null":
        raise ValueError(f"nan must be null, zero or drop, got {nan!r}")
    return edges.select(subject, "roi_i", "roi_j", fisher_z(r).alias("z"))


def fc_edges(
    ts: DataFrame,
    subject: str = "subject_id",
    denominator: str = "n",
    nan: str = "null",
    required: DataFrame | None = None,
    n_rois: int | None = None,
) -> DataFrame:
    """Correlation edges of long time series.

    With `n_rois`, subjects with another set of regions are left out. `required` ids must
    all be present (strict form).
    """
    if n_rois is not None:
        ts = ts.join(roi_count_mismatch(ts, n_rois, subject), subject, "left_anti")
    return fc_edges_of_vectors(timeseries_vectors(ts, subject), subject, denominator, nan, required)


def fc_edges_of_vectors(
    vectors: DataFrame, subject: str = "subject_id", denominator: str = "n", nan: str = "null", required: DataFrame | None = None
) -> DataFrame:
    """Correlation edges of (subject, t, values[R]) rows, as decoded from array files.

    The rows are summed up where they are; only R x R sums per subject are shuffled.
    """
    edges = correlation_edges(roi_covariance(vectors, subject), subject, denominator, nan)
    if required is None:
        return edges
    found = edges.withColumn("_hit", F.lit(True))
    message = F.concat(F.lit("no usable time series for "), F.col(subject).cast("string"))
    checked = F.when(F.col("_hit"), F.col(subject)).otherwise(
        F.raise_error(message).cast(edges.schema[subject].dataType)
    )
    return required.select(subject).join(found, subject, "left").withColumn(subject, checked).drop("_hit")


def edge_vectors(edges: DataFrame, subject: str = "subject_id") -> DataFrame:
    """One feature array per subject in row-major upper-triangle order (n(n-1)/2 wide)."""
    cells = F.array_sort(F.collect_list(F.struct("roi_i", "roi_j", "z")))
    return edges.groupBy(subject).agg(F.transform(cells, lambda c: c["z"]).alias("features"))


def with_edge_ordinal(edges: DataFrame, n_rois: int) -> DataFrame:
    return edges.withColumn("edge", edge_ordinal("roi_i", "roi_j", n_rois))


def zscore_over_time(ts: DataFrame, subject: str = "subject_id") -> DataFrame:
    """z-score of every region over time (population sd, constant regions give 0)."""
    stats = ts.groupBy(subject, "roi").agg(
        F.avg("value").alias("_m"),
        F.when(F.min("value") < F.max("value"), F.stddev_pop("value")).otherwise(1.0).alias("_s"),
    )
    return ts.join(stats, [subject, "roi"]).select(
        subject, "t", "roi", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).alias("z")
    )


def _one_group(groups: DataFrame) -> DataFrame:
    """The groups' table with one row per region; a region in two groups is an error."""
    several = F.raise_error(F.concat(F.lit("region in several groups: "), F.col("roi").cast("string"))).cast("string")
    found = groups.groupBy("roi").agg(F.min("grp").alias("_least"), F.max("grp").alias("_most"))
    return found.select("roi", F.when(F.col("_least") == F.col("_most"), F.col("_least")).when(F.col("_most").isNotNull(), several).alias("grp")).filter("grp is not null")


def _with_group(df: DataFrame, groups: DataFrame, roi: str, out: str) -> DataFrame:
    """Add the group of a region column; rows of unlisted regions are dropped."""
    return df.join(groups.select(F.col("roi").alias(roi), F.col("grp").alias(out)), roi)


def _group_covariance(cells: DataFrame, subject: str, groups: DataFrame, value: Column, valid: Column | None = None) -> DataFrame:
    """Average region-pair values into group pairs (a <= b), over valid regions only.

    `share` is the valid part of the regions of a group, on the rows with a = b.
    """
    groups = _one_group(groups)
    both = _with_group(_with_group(cells, groups, "roi_i", "gi"), groups, "roi_j", "gj")
    diagonal = F.col("roi_i") == F.col("roi_j")
    used = F.lit(True) if valid is None else valid
    # An off-diagonal region pair inside one group stands for both of its orders.
    weight = F.when((F.col("gi") == F.col("gj")) & ~diagonal, 2).otherwise(1)
    rows = both.select(
        subject, F.least("gi", "gj").alias("ga"), F.greatest("gi", "gj").alias("gb"),
        F.when(used, value).alias("_v"), F.when(used, weight).otherwise(0).alias("_w"), F.when(diagonal, used.cast("int")).alias("_ok"),
    )
    return rows.groupBy(subject, "ga", "gb").agg(
        F.sum(F.col("_v") * F.col("_w")).alias("total"), F.sum("_w").alias("pairs"), F.avg("_ok").alias("share")
    )


def _group_edges(pairs: DataFrame, subject: str, nan: str, min_share: float | None = None) -> DataFrame:
    """Fisher-z edges between groups from (subject, ga, gb, total, pairs, share)."""
    cov = F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs"))
    own = F.col("ga") == F.col("gb")
    # A subject has one cell per pair of groups, so its cells fit one row.
    packed = pairs.groupBy(subject).agg(
        F.map_from_entries(F.collect_list(F.when(own, F.struct(F.col("ga"), cov.alias("var"))))).alias("_var"),
        F.collect_list(F.when(~own, F.struct(F.col("ga"), F.col("gb"), cov.alias("cov")))).alias("_cov"),
        F.min(F.when(own, F.col("share"))).alias("_worst"),
    )
    if min_share is not None:
        packed = packed.filter((F.col("_worst") >= min_share) & (F.col("_worst") > 0))
    tiny = 1e-12

    def edge(c: Column) -> Column:
        va, vb = F.col("_var")[c["ga"]], F.col("_var")[c["gb"]]
        r = F.when((va > tiny) & (vb > tiny), c["cov"] / F.sqrt(va * vb))
        return F.struct(c["ga"].alias("group_i"), c["gb"].alias("group_j"), (F.coalesce(r, F.lit(0.0)) if nan == "zero" else r).alias("r"))

    edges = packed.withColumn("_e", F.transform("_cov", edge))
    if nan == "drop":
        edges = edges.filter(~F.exists("_e", lambda e: e["r"].isNull()))
    return edges.select(subject, F.inline("_e")).select(subject, "group_i", "group_j", fisher_z("r").alias("z"))


def network_fc(cov: DataFrame, networks: DataFrame, subject: str = "subject_id", nan: str = "null") -> DataFrame:
    """Edges between networks of averaged z-scored regions.

    The covariance of two averaged z-scored series is the mean of the region
    correlations across them (constant regions contribute 0).
    """
    defined = (F.col("var_i") > 0) & (F.col("var_j") > 0)
    r = F.when(defined, F.col("cov") / F.sqrt(F.col("var_i") * F.col("var_j"))).otherwise(0.0)
    groups = networks.select("roi", F.col("network").alias("grp"))
    return _group_edges(_group_covariance(cov, subject, groups, r), subject, nan)


def group_fc_qc(
    cov: DataFrame,
    groups: DataFrame,
    kept_rois: DataFrame | None = None,
    std_threshold: float = 1e-6,
    min_fraction: float = 0.5,
    subject: str = "subject_id",
) -> DataFrame:
    """Edges between groups of averaged raw valid regions, with per-subject quality rules.

    A subject is dropped when any group has fewer than `min_fraction` valid kept regions
    or a constant average. Groups without a kept region do not take part.
    """
    dim = groups.select("roi", "grp")
    if kept_rois is not None:
        dim = dim.join(kept_rois.select("roi"), "roi", "left_semi")
    valid = (F.sqrt("var_i") > std_threshold) & (F.sqrt("var_j") > std_threshold)
    pairs = _group_covariance(cov, subject, dim, F.col("cov"), valid)
    return _group_edges(pairs, subject, "drop", min_fraction)


def map_networks(rois: DataFrame, mapping: dict[str, str] | None = None, column: str = "network17", out: str = "network7") -> DataFrame:
    """Coarser network per region; an unmapped name is an error."""
    pairs = mapping or NETWORK_17_TO_7
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    got = table[F.col(column)]
    return rois.withColumn(
        out, F.when(got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit("unmapped network: "), F.col(column))))
    )


def select_networks(rois: DataFrame, networks: Sequence[str], name: str = "roi_name") -> DataFrame:
    """Regions whose parsed network is in the set; an empty selection is an error."""
    from pairlens.functions.labels import network_of

    kept = rois.filter(network_of(name).isin(list(networks)))
    if kept.isEmpty():
        raise ValueError(f"no region belongs to {sorted(networks)}")
    return kept
