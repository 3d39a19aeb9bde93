"""Quality control of region series, feature tables and atlas coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROIS = 100_000


def drop_nan_rows(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows whose feature array holds no NaN and no NULL."""
    return df.filter(~F.exists(features, lambda x: x.isNull() | F.isnan(x)))


def drop_report(df: DataFrame, features: str = "features") -> DataFrame:
    bad = F.exists(features, lambda x: x.isNull() | F.isnan(x))
    return df.agg(
        F.count(F.lit(1)).alias("n_input"), F.count_if(~bad).alias("n_kept"), F.count_if(bad).alias("n_dropped")
    )


def validity_flags(ts: DataFrame, threshold: float = 1e-6, subject: str = "subject_id") -> DataFrame:
    """Region is valid when its sd over time exceeds the threshold."""
    sd = F.when(F.min("value") < F.max("value"), F.stddev_pop("value")).otherwise(0.0)
    return ts.groupBy(subject, "roi").agg(sd.alias("sd")).withColumn("valid", F.col("sd") > threshold)


def roi_valid_rates(flags: DataFrame) -> DataFrame:
    return flags.groupBy("roi").agg(F.avg(F.col("valid").cast("int")).alias("valid_rate"))


def _rate_table(flags: DataFrame) -> DataFrame:
    """Valid rates as a driver-side table: one row per region, size checked, computed once."""
    rows = roi_valid_rates(flags).limit(MAX_ROIS + 1).collect()
    if len(rows) > MAX_ROIS:
        raise ValueError(f"more than {MAX_ROIS} regions")
    return flags.sparkSession.createDataFrame(rows, roi_valid_rates(flags).schema)


def kept_rois(flags: DataFrame, threshold: float) -> DataFrame:
    """Regions valid often enough; none at all is an error."""
    kept = _rate_table(flags).filter(F.col("valid_rate") >= threshold)
    if kept.isEmpty():
        raise ValueError(f"no region passes the validity threshold {threshold}")
    return kept


def subject_invalid_rates(flags: DataFrame, rois: DataFrame | None = None, subject: str = "subject_id") -> DataFrame:
    """Share of invalid regions per subject, over `rois` or all regions."""
    part = flags if rois is None else flags.join(rois.select("roi"), "roi", "left_semi")
    return part.groupBy(subject).agg(
        (1 - F.avg(F.col("valid").cast("int"))).alias("invalid_rate"), F.count_if("valid").alias("n_valid")
    )


def kept_subjects(flags: DataFrame, rois: DataFrame, threshold: float, subject: str = "subject_id") -> DataFrame:
    return subject_invalid_rates(flags, rois, subject).filter(F.col("invalid_rate") <= threshold)


def roi_qc(
    flags: DataFrame, roi_threshold: float = 0.9, subject_threshold: float = 0.1, subject: str = "subject_id"
) -> DataFrame:
    """One-row report: kept regions and subjects, and the spread of both rates."""
    rates = _rate_table(flags)
    kept = rates.filter(F.col("valid_rate") >= roi_threshold)
    if kept.isEmpty():
        raise ValueError(f"no region passes the validity threshold {roi_threshold}")
    roi_part = rates.agg(
        F.count(F.lit(1)).alias("n_rois_input"),
        F.count_if(F.col("valid_rate") >= roi_threshold).alias("n_rois_kept"),
        F.min("valid_rate").alias("roi_valid_rate_min"),
        F.median("valid_rate").alias("roi_valid_rate_median"),
        F.max("valid_rate").alias("roi_valid_rate_max"),
    )
    # Rates take at most n_rois + 1 values, so the exact median works on their counts.
    spread = (
        subject_invalid_rates(flags, kept, subject)
        .groupBy("invalid_rate")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("n_subjects_input"),
            F.sum(F.when(F.col("invalid_rate") <= subject_threshold, F.col("n")).otherwise(0)).alias("n_subjects_kept"),
            F.min("invalid_rate").alias("subject_invalid_rate_min"),
            F.percentile("invalid_rate", F.lit(0.5), F.col("n")).alias("subject_invalid_rate_median"),
            F.max("invalid_rate").alias("subject_invalid_rate_max"),
        )
    )
    return roi_part.withColumn("_s", spread.select(F.struct("*")).scalar()).select(*roi_part.columns, "_s.*")


def subject_health(flags: DataFrame, min_valid: int, subject: str = "subject_id") -> DataFrame:
    """Counts of all-constant subjects and spread of valid-region counts."""
    per_subject = flags.groupBy(subject).agg(F.count_if("valid").alias("n_valid"))
    by_count = per_subject.groupBy("n_valid").agg(F.count(F.lit(1)).alias("n"))
    return by_count.agg(
        F.sum("n").alias("n_subjects"),
        F.sum(F.when(F.col("n_valid") == 0, F.col("n")).otherwise(0)).alias("n_all_zero"),
        F.sum(F.when(F.col("n_valid") >= min_valid, F.col("n")).otherwise(0)).alias("n_enough"),
        F.min("n_valid").alias("valid_min"),
        F.percentile("n_valid", F.lit(0.5), F.col("n")).alias("valid_median"),
        (F.sum(F.col("n_valid") * F.col("n")) / F.sum("n")).alias("valid_mean"),
        F.max("n_valid").alias("valid_max"),
    )


def sort_by_valid_count(flags: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Subjects with their valid-region count, most valid first."""
    counts = flags.groupBy(subject).agg(F.count_if("valid").alias("n_valid"))
    return counts.orderBy(F.col("n_valid").desc(), subject)


def qc_extremes(flags: DataFrame, n_rois: int = 10, n_subjects: int = 3, subject: str = "subject_id") -> DataFrame:
    """Lowest regions by validity and the best and worst subjects, one row each."""
    rois = roi_valid_rates(flags).orderBy("valid_rate", "roi").limit(n_rois)
    subjects = subject_invalid_rates(flags, None, subject)
    best = subjects.orderBy("invalid_rate", subject).limit(n_subjects)
    worst = subjects.orderBy(F.col("invalid_rate").desc(), subject).limit(n_subjects)

    def rows(df: DataFrame, kind: str, name: str, value: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.col(value).alias("rate"))

    return (
        rows(rois, "lowest_roi", "roi", "valid_rate")
        .unionByName(rows(best, "best_subject", subject, "invalid_rate"))
        .unionByName(rows(worst, "worst_subject", subject, "invalid_rate"))
    )


def atlas_overlap(voxels: DataFrame, atlas: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Share of non-zero voxels inside the atlas mask per subject.

    The mask has as many rows as an image has voxels, whatever the number of subjects, and goes to every task: by voxel, all subjects' rows of one would share a task.
    """
    inside = voxels.join(F.broadcast(atlas.select("voxel").distinct()), "voxel", "left_semi")
    return inside.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n_voxels"), F.avg((F.col("value") != 0).cast("int")).alias("overlap")
    )


def status_flags(subjects: DataFrame, overlap: DataFrame, subject: str = "subject_id") -> DataFrame:
    """ok / zero_overlap / missing per requested subject."""
    joined = subjects.select(subject).join(overlap, subject, "left")
    status = F.when(F.col("overlap").isNull(), "missing").when(F.col("overlap") == 0, "zero_overlap").otherwise("ok")
    return joined.withColumn("status", status)


def qc_flow(status: DataFrame, health: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Real crosstab of all-zero series against zero atlas overlap."""
    flags = status.join(health, subject, "left")
    return flags.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("n_valid") == 0).alias("n_all_zero"),
        F.count_if(F.col("n_valid") > 0).alias("n_with_signal"),
        F.count_if(F.col("n_valid").isNull()).alias("n_without_series"),
    )


def overlap_histogram(overlap: DataFrame, bins: int = 30, value: str = "overlap") -> DataFrame:
    """Equal-width histogram between the extremes, last bin closed, empty bins kept."""
    spec = overlap.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s"))
    x, lo, hi = F.col(value), F.col("_s.lo"), F.col("_s.hi")
    raw = F.floor((x - lo) * bins / (hi - lo)).cast("int")
    bucket = F.when(lo == hi, F.lit(bins // 2)).otherwise(F.least(raw, F.lit(bins - 1)))
    counts = overlap.withColumn("_s", spec.scalar()).groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = overlap.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def table_profile(df: DataFrame, features: str = "features") -> DataFrame:
    """Shape, NaN and infinity counts, extremes of a feature-array table."""
    x = F.col(features).cast("array<double>")
    finite = F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size(x)).cast("long").alias("n_features"),
        F.sum(F.size(F.filter(x, lambda v: F.isnan(v)))).alias("n_nan"),
        F.sum(F.size(F.filter(x, lambda v: F.abs(v) == float("inf")))).alias("n_inf"),
        F.min(F.array_min(finite)).alias("min_value"),
        F.max(F.array_max(finite)).alias("max_value"),
    )


def imbalance_flag(df: DataFrame, label: str = "y") -> DataFrame:
    """Prefer average precision when fewer than 20 % or more than 80 % are positive."""
    rate = F.avg(F.col(label).cast("int"))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        rate.alias("prevalence"),
        F.when((rate < 0.2) | (rate > 0.8), "ap").otherwise("auc").alias("preferred_metric"),
    )
