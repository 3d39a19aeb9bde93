"""Grouped second moments: the one data-sized pass behind every linear estimator.

A row carries the vector z = [1, covariates, x, y]. Per key, `moments` returns the
upper triangle of the sum of z z', which holds the counts, sums and cross-products
from which regression, scaling, PCA, CCA and their held-out scores follow.
Statistics of a training part are total minus fold, so one pass serves every fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.decode import key_groups, matrix

MAX_DIM = 4096
MAX_CELLS = 40_000_000  # moment cells the driver accepts (about 1 GB)
FLUSH_CELLS = 16_000_000  # doubles held per task before partial sums are handed on


@dataclass(frozen=True)
class Layout:
    """Positions inside z = [1, covariates, x, y]."""

    n_cov: int
    p: int
    q: int

    @property
    def dim(self) -> int:
        return 1 + self.n_cov + self.p + self.q

    @property
    def cov(self) -> slice:
        return slice(0, 1 + self.n_cov)

    @property
    def x(self) -> slice:
        return slice(1 + self.n_cov, 1 + self.n_cov + self.p)

    @property
    def y(self) -> slice:
        return slice(1 + self.n_cov + self.p, self.dim)


def z_vector(covariates: Column | None, x: Column | None = None, y: Column | None = None) -> Column:
    """The row vector [1, covariates, x, y] as array<double>."""
    parts = [F.array(F.lit(1.0))]
    parts += [c.cast("array<double>") for c in (covariates, x, y) if c is not None]
    return F.concat(*parts)


def build_covariates(*columns: str | Column, extra: str | Column | None = None) -> Column:
    """Covariate array without the intercept (which `z_vector` adds)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    base = F.array(*[c.cast("double") for c in cols])
    if extra is None:
        return base
    more = F.col(extra) if isinstance(extra, str) else extra
    return F.concat(base, more.cast("array<double>"))


def _partial_sums(keys: list[str]):
    def emit(acc, schema):
        for key, gram in acc.items():
            d = gram.shape[0]
            upper = [gram[i, i:] for i in range(d)]
            offsets = np.concatenate([[0], np.cumsum([len(u) for u in upper])]).astype(np.int32)
            arrays = [pa.array([v] * d, type=schema.field(k).type) for k, v in zip(keys, key)]
            arrays.append(pa.array(np.arange(d, dtype=np.int32)))
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(upper))))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "i", "tail"])

    def run(batches):
        acc: dict = {}
        schema = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            schema = batch.schema
            mat = matrix(batch.column("z"), finite=True)
            for key, own in key_groups([batch.column(k) for k in keys], batch.num_rows):
                rows = mat[own] if keys else mat
                gram = rows.T @ rows
                if key in acc:
                    acc[key] += gram
                else:
                    acc[key] = gram
                if len(acc) * gram.size > FLUSH_CELLS:
                    yield from emit(acc, schema)
                    acc = {}
        if acc:
            yield from emit(acc, schema)

    return run


MIN_TASKS = 4096


def few_tasks(df: DataFrame) -> DataFrame:
    """Read with a few tasks per core instead of one per input split, without a shuffle.

    Each task ends in one features x features partial result, so their number, not the
    data, decides how much is summed up afterwards. Never below MIN_TASKS, as the cores
    known at planning time may be few under dynamic allocation.
    """
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, shuffle, MIN_TASKS))


def moments(df: DataFrame, keys: Sequence[str], z: str | Column, many_keys: bool = False) -> DataFrame:
    """Sum of z z' per key as long rows (keys..., i, j, s) with i <= j.

    Every task reduces its rows with one matrix product per key and batch and sends
    only its partial sums, as compact arrays, so a hot key is split over all tasks.
    With few keys the number of tasks is bounded (`few_tasks`); `many_keys` keeps them
    all, for keys such as subjects that live in one or few tasks each.
    """
    keys = list(keys)
    zcol = F.col(z) if isinstance(z, str) else z
    rows = df.select(*keys, zcol.cast("array<double>").alias("z"))
    if not many_keys:
        rows = few_tasks(rows)
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("tail", T.ArrayType(T.DoubleType()))]
    )
    return sum_rows(rows.mapInArrow(_partial_sums(keys), schema), keys)


def sum_rows(partial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up partial matrices given as rows (keys..., i, tail) where tail starts at column i.

    The exchange moves compact arrays; the explode and the sum after it reuse its
    partitioning, so there is one shuffle.
    """
    keys = list(keys)
    spread = partial.repartition(*keys, "i")
    cells = spread.select(*keys, "i", F.posexplode("tail").alias("_off", "_v"))
    cells = cells.select(*keys, "i", (F.col("i") + F.col("_off")).alias("j"), "_v")
    return cells.groupBy(*keys, "i", "j").agg(F.sum("_v").alias("s"))


def matrix_from_cells(i, j, s, dim: int | None = None) -> np.ndarray:
    """Symmetric matrix from upper-triangle cells."""
    i, j, s = np.asarray(i), np.asarray(j), np.asarray(s, dtype=np.float64)
    d = int(j.max()) + 1 if dim is None else dim
    out = np.zeros((d, d))
    out[i, j] = s
    out[j, i] = s
    return out


def collect_moments(mom: DataFrame, keys: Sequence[str] = (), max_cells: int = MAX_CELLS) -> dict[tuple, np.ndarray]:
    """Bring moment matrices to the driver in one job.

    Their size depends on features and keys only; more than `max_cells` cells is an error.
    """
    keys = list(keys)
    table = mom.limit(max_cells + 1).toPandas()
    if len(table) > max_cells:
        raise ValueError(f"more than {max_cells} moment cells; reduce the features with block PCA first")
    if table.empty:
        return {}
    dim = int(table["j"].max()) + 1
    if not keys:
        return {(): matrix_from_cells(table["i"], table["j"], table["s"], dim)}
    return {
        key if isinstance(key, tuple) else (key,): matrix_from_cells(part["i"], part["j"], part["s"], dim)
        for key, part in table.groupby(keys, sort=True)
    }


def column_stats(mom: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean and population sd per feature from moments whose z starts with 1."""
    keys = list(keys)
    first = mom.filter("i = 0").select(*keys, "j", F.col("s").alias("_s1"))
    diag = mom.filter("i = j").select(*keys, "j", F.col("s").alias("_s2"))
    n = mom.filter("i = 0 and j = 0")
    joined = first.filter("j > 0").join(diag, [*keys, "j"])
    if keys:
        joined = joined.join(n.select(*keys, F.col("s").alias("n")), keys)
    else:
        joined = joined.withColumn("n", n.select("s").scalar())
    mean = F.col("_s1") / F.col("n")
    var = F.greatest(F.col("_s2") / F.col("n") - mean * mean, F.lit(0.0))
    return joined.select(
        *keys, (F.col("j") - 1).alias("feature"), F.col("n").cast("long").alias("n"), mean.alias("mean"), F.sqrt(var).alias("sd")
    )
