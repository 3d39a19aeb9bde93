"""Weight tables turned into feature, node and group rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.ranking import top_k


def sparsity(weights: DataFrame, keys: Sequence[str], tol: float = 1e-6, weight: str = "weight") -> DataFrame:
    """Share of weights below tol in magnitude."""
    return weights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.abs(weight) < tol).cast("int")).alias("sparsity")
    )


def gene_weight_rollup(weights: DataFrame, gene: str = "gene", weight: str = "weight", keys: Sequence[str] = ()) -> DataFrame:
    """L2 norm and mean magnitude of the weights of each gene block, per key."""
    w = F.col(weight)
    return weights.groupBy(*keys, gene).agg(F.sqrt(F.sum(w * w)).alias("l2"), F.avg(F.abs(w)).alias("mean_abs"))


def topk_features(
    weights: DataFrame, keys: Sequence[str], k: int, weight: str = "weight", position: str = "position"
) -> DataFrame:
    """Largest magnitudes per key with their sign; the later feature wins a tie."""
    return top_k(weights, keys, [F.abs(weight).desc(), F.col(position).desc()], k)


def topk_overlap(a: DataFrame, b: DataFrame, k: int, name: str = "feature", weight: str = "weight", position: str = "position") -> DataFrame:
    """Size and members of the overlap of two top-k sets."""
    tops = [topk_features(d, [], k, weight, position).select(name) for d in (a, b)]
    common = tops[0].intersect(tops[1])
    return common.agg(
        F.count(F.lit(1)).alias("n_overlap"), F.array_join(F.sort_array(F.collect_list(name)), ",").alias("members")
    )


def edge_to_node(edges: DataFrame, keys: Sequence[str] = (), i: str = "roi_i", j: str = "roi_j", weight: str = "weight") -> DataFrame:
    """Node weight = sum of |weight| over its edges, and its share of the total."""
    keys = list(keys)
    ends = edges.select(*keys, F.explode(F.array(i, j)).alias("node"), F.abs(weight).alias("_w"))
    nodes = ends.groupBy(*keys, "node").agg(F.sum("_w").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(*keys))  # one row per node
    return nodes.withColumn("weight_norm", F.col("weight") / (total + 1e-10))


def rank_nodes(nodes: DataFrame, keys: Sequence[str] = (), weight: str = "weight", node: str = "node", rank: str = "rank") -> DataFrame:
    """1-based ranking by weight; the lower node index comes first on a tie. One row per node."""
    w = Window.partitionBy(*keys).orderBy(F.col(weight).desc(), F.col(node))
    return nodes.withColumn(rank, F.row_number().over(w))


def category_rollup(ranked: DataFrame, categories: DataFrame, node: str = "node") -> DataFrame:
    """Per category: total weights, number of nodes, their ranks and mean rank."""
    joined = ranked.join(categories.select(F.col("roi").alias(node), "category"), node)
    return joined.groupBy("category").agg(
        F.sum("weight").alias("total_weight"),
        F.sum("weight_norm").alias("total_weight_norm"),
        F.count(F.lit(1)).alias("n_rois"),
        F.sort_array(F.collect_list("rank")).alias("ranks"),
        F.avg("rank").alias("mean_rank"),
    )


def cosine_similarity(a: DataFrame, b: DataFrame, on: Sequence[str], keys: Sequence[str] = (), weight: str = "weight") -> DataFrame:
    """Cosine of two weight tables; a feature absent on one side counts as 0, a zero norm gives 0."""
    keys, on = list(keys), list(on)
    left = a.select(*keys, *on, F.col(weight).cast("double").alias("_a"))
    right = b.select(*keys, *on, F.col(weight).cast("double").alias("_b"))
    both = left.join(right, [*keys, *on], "full_outer").na.fill(0.0, ["_a", "_b"])
    norm = F.sqrt(F.sum(F.col("_a") * F.col("_a"))) * F.sqrt(F.sum(F.col("_b") * F.col("_b")))
    dot = F.sum(F.col("_a") * F.col("_b"))
    return both.groupBy(*keys).agg(F.coalesce(F.when(norm > 0, dot / norm), F.lit(0.0)).alias("cosine"))


def weight_profile(weights: DataFrame, keys: Sequence[str], active: float = 0.01, tol: float = 1e-6, weight: str = "weight") -> DataFrame:
    """Mean, sd, largest magnitude, active count and sparsity of a weight vector."""
    w = F.col(weight)
    return weights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(w).alias("mean"),
        F.stddev_pop(w).alias("std"),
        F.max(F.abs(w)).alias("max_abs"),
        F.count_if(F.abs(w) > active).alias("n_active"),
        F.avg((F.abs(w) < tol).cast("int")).alias("sparsity"),
    )


def weight_correlation(a: DataFrame, b: DataFrame, on: Sequence[str], weight: str = "weight") -> DataFrame:
    """Pearson correlation of two weight tables over their common features."""
    both = a.select(*on, F.col(weight).alias("_a")).join(b.select(*on, F.col(weight).alias("_b")), list(on))
    ok = (F.min("_a") < F.max("_a")) & (F.min("_b") < F.max("_b"))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.when(ok, F.covar_pop("_a", "_b") / (F.stddev_pop("_a") * F.stddev_pop("_b"))).alias("r")
    )


def known_gene_ranks(wanted: DataFrame, weights: DataFrame, top: int = 20, keys: Sequence[str] = ("grp",), gene: str = "gene", weight: str = "weight") -> DataFrame:
    """Rank of each wanted gene per group, NULL with a note when it is outside the top."""
    w = Window.partitionBy(*keys).orderBy(F.abs(weight).desc(), F.col(gene))  # one row per gene
    ranked = weights.withColumn("rank", F.row_number().over(w))
    found = ranked.join(wanted.select(gene), gene, "left_semi")
    inside = F.col("rank") <= top
    return found.select(
        *keys, gene, F.when(inside, F.col("rank")).alias("rank"),
        F.when(inside, F.col("rank").cast("string")).otherwise(f"outside top {top}").alias("note"),
    )


def feature_component_grid(weights: DataFrame, components: Sequence[int], k: int = 10, n_features: int = 15, position: str = "position") -> DataFrame:
    """Union of the top-k features of each component, first n by name, zero-filled grid."""
    top = topk_features(weights.filter(F.col("component").isin(list(components))), ["component"], k, position=position)
    names = top.select("feature").distinct().orderBy("feature").limit(n_features)
    cells = top.join(names, "feature", "left_semi")
    grid = cells.groupBy("feature").pivot("component", list(components)).agg(F.first("weight"))
    renamed = grid.select("feature", *[F.col(str(c)).alias(f"cc{c}") for c in components])
    return renamed.na.fill(0.0)


def l1_project(weights: DataFrame, bound: float, keys: Sequence[str] = (), weight: str = "weight", position: str = "position") -> DataFrame:
    """Soft-threshold a long weight vector to an L1 bound and scale it to unit length.

    The threshold comes in closed form from the running sum of the sorted magnitudes.
    One row per feature; the features of one vector fit one window partition.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("_m").desc(), F.col(position))
    whole = Window.partitionBy(*keys)
    mag = weights.withColumn("_m", F.abs(weight))
    lam = (F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)) - bound) / F.row_number().over(w)
    steps = mag.withColumn("_lam", lam)
    # The last sorted position whose magnitude still exceeds its own threshold sets it.
    best = F.max(F.when(F.col("_m") > F.col("_lam"), F.col("_lam"))).over(whole)
    shrunk = steps.withColumn("_l", F.when(F.sum("_m").over(whole) > bound, F.greatest(best, F.lit(0.0))).otherwise(0.0))
    value = F.signum(weight) * F.greatest(F.col("_m") - F.col("_l"), F.lit(0.0))
    out = shrunk.withColumn("_v", value)
    norm = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(whole))
    return out.select(*weights.columns, F.when(norm > 1e-10, F.col("_v") / norm).otherwise(F.col("_v")).alias("projected"))


def map_back_weights(components: DataFrame, weights: DataFrame) -> DataFrame:
    """Component-space weights to original features: sum over pc of loading * weight."""
    return (
        components.join(weights, "pc")
        .groupBy("feature", "component")
        .agg(F.sum(F.col("loading") * F.col("weight")).alias("weight"))
    )
