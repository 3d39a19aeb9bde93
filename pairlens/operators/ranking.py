"""Ordering primitives that never put a whole hot group into one task.

A plain `row_number() over (partition by label ...)` sends every row of a label to
one task. The functions below split each group into buckets (by hash prefix or by
approximate quantile), order inside a bucket and add the totals of the buckets
before it, which gives the same exact result from bounded window partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _extreme_row(df: DataFrame, key: Sequence[str], order: Column, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    # Partial aggregation keeps one row per key and task, so a hot key does not travel whole.
    picked = df.groupBy(*key).agg(pick(F.struct(*rest), order).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, key: str | Sequence[str], position: str) -> DataFrame:
    """The row with the lowest position of every key."""
    keys = [key] if isinstance(key, str) else list(key)
    return _extreme_row(df, keys, F.col(position), F.min_by)


def keep_last(df: DataFrame, key: str | Sequence[str], position: str) -> DataFrame:
    """The row with the highest position of every key."""
    keys = [key] if isinstance(key, str) else list(key)
    return _extreme_row(df, keys, F.col(position), F.max_by)


def argmax_rows(df: DataFrame, keys: Sequence[str], metric: str, position: str) -> DataFrame:
    """Row with the highest metric per key; the earliest position wins a tie, NULL and NaN never win."""
    usable = df.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    order = F.struct(F.col(metric), -F.col(position))
    if keys:
        return _extreme_row(usable, list(keys), order, F.max_by)
    picked = usable.agg(F.max_by(F.struct(*df.columns), order).alias("_row")).filter("_row is not null")
    return picked.select("_row.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key in the given order. Spark trims to k per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def hash_order(id_col: str | Column, seed: int | Column) -> Column:
    """Pseudo-random but engine-independent sort key of a row."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    suffix = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat(ident.cast("string"), F.lit("|"), suffix))


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: int,
    rank: str = "rank",
    hex_digits: int | None = None,
    annotate: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Exact 1-based rank of every row in hash order within its key.

    Rows are bucketed by the leading hex digits of the hash, which are uniform, so a
    window partition holds about n / 16**hex_digits rows whatever the key sizes are. By default there are
    16 to 256 buckets per shuffle partition, which grow with the data as those do.
    `annotate` may add columns to the table of bucket sizes (keys..., _b, _n), which then
    arrive at every row with the one join that is needed anyway.
    """
    if hex_digits is None:
        hex_digits = max(3, len(f"{int(df.sparkSession.conf.get('spark.sql.shuffle.partitions')):x}") + 1)
    hashed = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_b", F.substring("_h", 1, hex_digits))
    group = [*keys, "_b"]
    sizes = hashed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    # At most 16**hex_digits rows per key reach this window.
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if annotate is not None:
        offsets = annotate(offsets)
    inner = Window.partitionBy(*group).orderBy("_h", id_col)
    joined = hashed.join(offsets.drop("_n"), group)
    return joined.withColumn(rank, F.row_number().over(inner) + F.col("_off")).drop("_h", "_b", "_off")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    buckets: int | None = None,
    totals: bool = False,
    borders_from: DataFrame | None = None,
) -> DataFrame:
    """Add `<c>_before`: per key, the sum of column c over all rows with a smaller order value.

    Exact for distinct order values within a key. Bucket borders are quantiles of the
    order value over all keys (a mergeable sketch, one small array), so no window
    partition exceeds about n / buckets rows even if one key holds most of them; the
    result does not depend on where the borders fall. `borders_from` may hold the same
    order column in a form that is cheaper to scan than an aggregated `df`. With `totals`,
    `<c>_total` is the sum over the whole key.
    """
    keys = list(keys)
    if buckets is None:  # as many as shuffle partitions, rounded up to a power of two
        buckets = max(64, 1 << (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    source = df if borders_from is None else borders_from
    borders = source.agg(F.percentile_approx(order, probs, F.lit(20 * buckets)).alias("b"))
    tagged = df.withColumn("_borders", borders.scalar()).withColumn("_b", F.lit(0))
    step = buckets // 2
    while step:  # binary search for the number of borders below the value
        tagged = tagged.withColumn("_b", F.col("_b") + F.when(F.col(order) > F.get("_borders", F.col("_b") + (step - 1)), step).otherwise(0))
        step //= 2
    tagged = tagged.drop("_borders")
    group = [*keys, "_b"]
    per_bucket = tagged.groupBy(*group).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    whole = Window.partitionBy(*keys)  # at most `buckets` rows per key
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *group,
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *([F.sum(f"_t_{c}").over(whole).alias(f"{c}_total") for c in sums] if totals else []),
    )
    inner = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = tagged.join(offsets, group)
    out = [(F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums]
    return joined.select(*df.columns, *out, *([f"{c}_total" for c in sums] if totals else []))
