"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more coordinate, so that all are equally long; then a larger inner product with a query (whose new
coordinate is 0) is a smaller distance. Each vector is keyed by its nearest pivot and its distance to it, and a pivot's vectors are cut into
annuli by distance. A query takes the annuli in the order of the triangle inequality's lower bound, |d(q, p) - d(x, p)|, in a few steps; after
each, its k-th best score bounds the distance that can still matter, and what lies beyond is never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.session import checkpointed, written

#: Pivots, chosen among so many vectors (the first by a hash); annuli per pivot; vectors and queries that one task compares at once.
PIVOTS, PIVOT_SAMPLE, ANNULI, BLOCK = 24, 4096, 16, 4096
#: Vectors that a query's first and second step look at, at least.
STEPS = (64, 4096)
SCALE = 1024


def quantized(vector: Column) -> Column:
    """floor(1024 x) of each component, null for a null vector or one with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | x.cast("double").isin(float("inf"), float("-inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("bigint")))


def _matrix(column: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; by floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Index:
    """Pivots, longest squared norm and annuli; what every task needs, independent of the number of vectors."""

    def __init__(self, pivots: np.ndarray, longest: float) -> None:
        self.pivots, self.longest = pivots, longest
        self.edges: np.ndarray | None = None

    def distances(self, rows: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances to all pivots: of vectors (lifted) or of queries."""
        rows = rows.astype(np.float64)
        norm = (rows**2).sum(axis=1)
        extra = np.sqrt(np.maximum(self.longest - norm, 0)) if lifted else np.zeros(len(rows))
        squared = norm[:, None] + extra[:, None] ** 2 + (self.pivots**2).sum(axis=1) - 2 * (rows @ self.pivots[:, :-1].T + extra[:, None] * self.pivots[:, -1])
        return np.sqrt(np.maximum(squared, 0))


def _choose_pivots(sample: np.ndarray, longest: float, n: int) -> np.ndarray:
    """Farthest-first pivots, lifted."""
    rows = sample.astype(np.float64)
    rows = np.concatenate([rows, np.sqrt(np.maximum(longest - (rows**2).sum(axis=1), 0))[:, None]], axis=1)
    chosen = [0]
    nearest = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(rows)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def build_index(vectors: DataFrame) -> tuple[Index, DataFrame]:
    """vectors: `vec_id`, `vec` (bigint array). Returns the index and the vectors with their `pivot`, `ring` and `dist`."""
    width, longest = vectors.agg(F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    width, longest = width or 0, longest or 0.0
    sample = vectors.orderBy(F.xxhash64("vec", "vec_id"), "vec_id").select("vec").limit(PIVOT_SAMPLE).toArrow()
    index = Index(_choose_pivots(_matrix(sample["vec"], width), longest, PIVOTS) if sample.num_rows else np.zeros((1, width + 1)), longest)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = index.distances(_matrix(batch.column(1), width), lifted=True)
            nearest = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(distance[np.arange(len(nearest)), nearest])], names=["vec_id", "vec", "pivot", "dist"])

    keyed = written(vectors.select("vec_id", "vec").mapInArrow(key, "vec_id bigint, vec array<bigint>, pivot int, dist double"), "keyed")
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / ANNULI for i in range(1, ANNULI)]).alias("cuts")).collect()  # a row per pivot
    index.edges = np.full((len(index.pivots), ANNULI - 1), np.inf)
    for pivot, edges in cuts:
        index.edges[pivot] = edges
    rings = F.lit(index.edges.tolist())
    ring = F.size(F.filter(F.element_at(rings, F.col("pivot") + 1), lambda e: e <= F.col("dist")))
    return index, keyed.withColumn("ring", ring)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `k` rows with the largest integer inner product for each query: `query_id`, `rank` (from 1), `vec_id`, `score`.

    queries: condition on the rows of `vectors` that are queries; a query never finds rows of its own id. Ties go to the smaller id. Vectors that are
    null or have a null or non-finite component, and rows with a null id, take no part; shorter vectors count as padded with zeros. Repeated ids:
    as candidates every row counts, as queries one of them. An empty table, or no query, gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), quantized(F.col(vector_col)).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(rows.where("vec is not null and vec_id is not null"), "vectors")
    index, keyed = build_index(rows)
    # Annuli with their bounds and sizes: a row for each pivot and ring.
    cells = keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("pivot", "ring").toArrow()
    pivot, ring, size, lo, hi = (cells[c].to_numpy() for c in ("pivot", "ring", "n", "lo", "hi"))
    width = len(index.pivots[0]) - 1
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    longest = index.longest

    # A cell of many vectors is split by a hash of the id, into parts of about `BLOCK`.
    number = F.element_at(F.lit([[int(np.flatnonzero((pivot == p) & (ring == r))[0]) if ((pivot == p) & (ring == r)).any() else -1 for r in range(ANNULI)] for p in range(len(index.pivots))]), F.col("pivot") + 1)
    parts = [int(-(-n // BLOCK)) for n in size]
    placed = keyed.withColumn("cell", F.element_at(number, F.col("ring") + 1))
    if parts:
        placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit(parts), F.col("cell") + 1)).cast("int"))
    else:
        placed = placed.withColumn("part", F.lit(0))
    placed = checkpointed(placed.select("cell", "part", "vec_id", "vec"))

    def plan(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The cells that a query compares in this step."""
            for batch in batches:
                vec = _matrix(batch.column(1), width)
                bound = np.asarray(batch.column(2).fill_null(-(2**62)))
                away = index.distances(vec, lifted=False)[:, pivot]
                least = np.maximum(np.maximum(lo - away, away - hi), 0)
                order = np.argsort(least, axis=1, kind="stable")
                before = np.take_along_axis(np.cumsum(np.take_along_axis(np.broadcast_to(size, least.shape), order, 1), axis=1), order.argsort(axis=1), 1) - size
                begin, end = (STEPS[step - 1] if step else 0), (STEPS[step] if step < len(STEPS) else np.inf)
                reach = np.sqrt(np.maximum((vec.astype(np.float64) ** 2).sum(axis=1) + longest - 2.0 * bound, 0))
                # Distances carry rounding errors, the scores don't: some slack keeps every tie.
                take = (before >= begin) & (before < end) & (least <= reach[:, None] * (1 + 1e-9) + 1e-3)
                row, cell = np.nonzero(take)
                out = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array([list(range(parts[c])) for c in cell], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(out, names=["query_id", "vec", "bound", "cell", "parts"])

        return run

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best k of one part of a cell for each query of a block that reach its bound so far."""
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        right = right.sort_by("vec_id")
        ids, asking = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
        score = _scores(_matrix(left["vec"], width), _matrix(right["vec"], width))
        other = asking[:, None] != ids
        score = np.where(other, score, -(2**62))
        floor = np.asarray(left["bound"].combine_chunks().fill_null(-(2**62)))[:, None]
        if score.shape[1] > k:
            floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k][:, None])
        row, at = np.nonzero((score >= floor) & other)
        order = np.lexsort((at, -score[row, at], row))
        row, at = row[order], at[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, at = row[rank < k], at[rank < k]
        return pa.table({"query_id": asking[row], "vec_id": ids[at], "score": score[row, at]})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for step in range(len(STEPS) + 1):
        if found is None:
            asking = asked.select("vec_id", "vec", F.lit(None).cast("bigint").alias("bound"))
        else:
            bounds = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
            asking = asked.join(bounds, "vec_id", "left").select("vec_id", "vec", "bound")
        wanted = asking.mapInArrow(plan(step), "query_id bigint, vec array<bigint>, bound bigint, cell int, parts array<int>")
        wanted = checkpointed(wanted.withColumn("part", F.explode("parts")).drop("parts"))
        blocks = wanted.groupBy("cell", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        left = wanted.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        right = placed.join(blocks, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        key = ["cell", "part", "block"]
        more = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_id bigint, vec_id bigint, score bigint")
        if found is not None:
            more = more.unionByName(found.select("query_id", "vec_id", "score"))
        found = checkpointed(more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    return found.select("query_id", "rank", "vec_id", "score")
