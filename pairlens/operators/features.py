"""Feature construction from embeddings and score vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.decode import matrix
from pairlens.functions.vectors import feature_set, pool_vector


def pool_embedding(
    df: DataFrame, embedding: str = "embedding", method: str = "mean", out: str = "value", vectorized: bool = False
) -> DataFrame:
    """Replace each embedding by one scalar, ignoring NaN; nothing usable gives NULL.

    The default is a column expression. `vectorized` reduces whole Arrow batches in NumPy,
    which is about twice as fast for vectors of several hundred values (all of one length).
    """
    if not vectorized:
        return df.withColumn(out, pool_vector(embedding, method)).drop(embedding)
    keep = [c for c in df.columns if c != embedding]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])
    if method not in ("mean", "max", "median"):
        raise ValueError(f"unknown pooling method: {method}")

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            mat = matrix(batch.column(embedding))
            empty = np.isnan(mat).all(axis=1)
            mat = np.where(empty[:, None], 0, mat)
            if method == "mean":
                value = np.nanmean(mat, axis=1, dtype=np.float64)
            elif method == "max":
                value = np.nanmax(mat, axis=1).astype(np.float64)
            else:
                wide = mat.astype(np.float64)
                value = np.nanmedian(wide, axis=1) if np.isnan(wide).any() else np.median(wide, axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(value, mask=empty)], names=[*keep, out])

    return df.select(*keep, embedding).mapInArrow(run, schema)


def gene_matrix(pooled: DataFrame, genes: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """One pooled column per gene in list order."""
    return pooled.groupBy(subject).pivot("gene", list(genes)).agg(F.first("value"))


def _one_per_gene(df: DataFrame, genes: Sequence[str], value: str, subject: str) -> DataFrame:
    """One column per gene. Partial aggregation leaves one row per subject and task."""
    picks = [F.first(F.when(F.col("gene") == g, F.col(value)), ignorenulls=True).alias(f"_{i}") for i, g in enumerate(genes)]
    return df.groupBy(subject).agg(*picks)


def gene_array(pooled: DataFrame, genes: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """Pooled values as one array in list order; NULL where a gene is absent."""
    wide = _one_per_gene(pooled, genes, "value", subject)
    return wide.select(subject, F.array(*[f"_{i}" for i in range(len(genes))]).alias("features"))


def widen_genes(blocks: DataFrame, genes: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """Concatenate embedding blocks in gene order; a subject lacking a gene is an error.

    Only for narrow totals: wide data stay long by gene block (see `block_pca`).
    """
    wide = _one_per_gene(blocks.filter(F.col("gene").isin(list(genes))), genes, "embedding", subject)
    message = F.concat(F.lit("subject lacks a gene block: "), F.col(subject).cast("string"))
    joined = F.concat(*[f"_{i}" for i in range(len(genes))])  # NULL as soon as one block is
    failed = F.raise_error(message).cast(blocks.schema["embedding"].dataType)
    return wide.select(subject, F.when(joined.isNotNull(), joined).otherwise(failed).alias("features"))


def feature_sets(variates: DataFrame, kinds: Sequence[str], keep: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Long table (keep..., feature_set, features) of the requested representations."""
    entries = F.array(*[F.struct(F.lit(k).alias("feature_set"), feature_set("u", "v", k).alias("features")) for k in kinds])
    return variates.select(*keep, F.inline(entries))


def early_fusion(x: str | Column, y: str | Column) -> Column:
    return F.concat(x, y)


def extract_covariate(df: DataFrame, name: str, out: str = "extra") -> DataFrame:
    """Copy one named feature out as a covariate."""
    if name not in df.columns:
        raise ValueError(f"no feature column named {name!r}")
    return df.withColumn(out, F.col(name).cast("double"))


def drop_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"no feature columns named {absent}")
    return df.drop(*names)


def drop_feature_rows(long_features: DataFrame, names: Sequence[str], feature: str = "feature") -> DataFrame:
    """The long form of `drop_features`."""
    return long_features.filter(~F.col(feature).isin(list(names)))


def residual_projection(pcs: str | Column, dim: int) -> Column:
    """First `dim` principal components of a score array."""
    return F.slice(pcs, 1, dim)
