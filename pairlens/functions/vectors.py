"""Numeric and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORR_CLIP = 0.999999


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round6(c: Column | str) -> Column:
    """Round to six decimals; adding 0.0 folds negative zero into zero."""
    return F.round(_col(c), 6) + F.lit(0.0)


def pool_vector(c: Column | str, method: str = "mean") -> Column:
    """Collapse an array to one double, ignoring NaN and NULL elements.

    `method` is mean, max or median. A vector without any usable element gives NULL.
    """
    clean = F.filter(_col(c).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(clean)
    if method == "mean":
        total = F.aggregate(clean, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(n > 0, total / n)
    if method == "max":
        return F.array_max(clean)
    if method == "median":
        ordered = F.sort_array(clean)  # natural order, without a comparator lambda
        lower = F.element_at(ordered, ((n + 1) / 2).cast("int"))
        upper = F.element_at(ordered, (n / 2).cast("int") + 1)
        return F.when(n > 0, (lower + upper) / 2)
    raise ValueError(f"unknown pooling method: {method}")


def fisher_z(r: Column | str) -> Column:
    """Clip a correlation away from +-1 and apply the inverse hyperbolic tangent."""
    clipped = F.greatest(F.lit(-CORR_CLIP), F.least(F.lit(CORR_CLIP), _col(r)))
    return F.when(_col(r).isNotNull(), F.atanh(clipped))


def soft_threshold(c: Column | str, lam: Column | float) -> Column:
    """sign(x) * max(|x| - lam, 0)."""
    x = _col(c)
    return F.signum(x) * F.greatest(F.abs(x) - lam, F.lit(0.0))


def edge_ordinal(i: Column | str, j: Column | str, n: int) -> Column:
    """Position of edge (i, j), i < j, in the row-major upper triangle of n nodes."""
    a, b = _col(i).cast("long"), _col(j).cast("long")
    return a * n - F.floor(a * (a + 1) / 2) + (b - a - 1)


def nodes_of_edges(n_edges: Column | str) -> Column:
    """Number of nodes whose upper triangle has this many edges."""
    return F.floor((1 + F.sqrt(1 + 8 * _col(n_edges))) / 2).cast("long")


def percent_difference(a: Column | str, b: Column | str) -> Column:
    """|b - a| as percent of the larger of the two."""
    x, y = _col(a), _col(b)
    top = F.greatest(x, y)
    return F.when(top != 0, F.abs(y - x) / top * 100)


def feature_set(u: Column | str, v: Column | str, kind: str) -> Column:
    """Representation of a pair of score vectors: one view, their concatenation or their mean."""
    a, b = _col(u), _col(v)
    if kind == "gene_only":
        return a
    if kind == "fmri_only":
        return b
    if kind == "joint":
        return F.concat(a, b)
    if kind == "joint_mean":
        return F.zip_with(a, b, lambda x, y: (x + y) / 2)
    raise ValueError(f"unknown feature set: {kind}")
