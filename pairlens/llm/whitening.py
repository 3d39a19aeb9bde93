"""Whitening of embeddings by an incremental eigendecomposition.

Each task keeps count, mean, eigenvalues and eigenvectors of the scatter of its rows and adds one row at a time: a centred rank-one update, whose eigenvalues are the
roots of a secular equation between the old ones, after deflation of what the update leaves alone. Tasks' spectra are combined, in a tree, by successive
rank-one updates: one for each eigenpair of the other, and one for the distance of the means. The basis so found is refined by a last pass over all rows:
Rayleigh-Ritz, the covariance within the basis, its exact eigenvectors there, and a turn of the basis by them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.arrays import matrix
from pairlens.session import checkpointed, written

#: Spectra that one task combines; steps of the root finder at most (each halves the bracket at least every other step).
FAN_IN, STEPS = 16, 120
#: A root counts as found where the equation is met to this part of its terms; the last pass over all rows has full precision.
CLOSE = 1e-11
_EPS = float(np.finfo(np.float64).eps)


def _deflate(d: np.ndarray, z: np.ndarray, q: np.ndarray, r: float) -> np.ndarray:
    """Which eigenvalues the update r z z' moves; turns q, z and d in place so that of (almost) equal ones only one is moved."""
    tolerance = 8 * _EPS * max(float(np.abs(d).max()), r)
    moved = r * np.abs(z) > tolerance
    at = np.flatnonzero(moved)
    if len(at) > 1:
        a, b = at[:-1], at[1:]
        close = (d[b] - d[a]) * np.abs(z[a] * z[b]) <= tolerance * (z[a] ** 2 + z[b] ** 2)
        # One turn can bring the next pair closer: from the first close pair on, pair by pair.
        for k in range(int(np.argmax(close)) if close.any() else len(a), len(a)):
            i, j = at[k], at[k + 1]
            length = np.hypot(z[i], z[j])
            c, s = z[j] / length, z[i] / length
            if abs((d[j] - d[i]) * c * s) <= tolerance:
                q[:, [i, j]] = np.stack([c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]], axis=1)
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                z[i], z[j] = 0.0, length
                moved[i] = False
    return moved


def secular_roots(d: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weight / (d - x)) for ascending, different d and positive weights, one right of each d.

    Returns `gaps`, gaps[i, j] = d[j] - (d next to root i), and the roots' distances from that next d; their difference d[j] - x[i] loses no digits.
    """
    with np.errstate(all="ignore"):
        return _roots(d, weight)


def _roots(d: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(d)
    index = np.arange(n)
    right = np.append(d[1:], d[-1] + weight.sum())
    half = (right - d) / 2
    f = 1 + (weight / (d - (d + half)[:, None])).sum(axis=1)
    # From the nearer pole; the last root has none to its right.
    left_side = (f >= 0) | (index == n - 1)
    origin = np.where(left_side, d, right)
    gaps = d - origin[:, None]
    low = np.where(left_side, np.where(f >= 0, 0, half), -half)
    high = np.where(left_side, np.where(f >= 0, half, 2 * half), 0.0)
    x = (low + high) / 2
    before = (index <= index[:, None]).astype(np.float64)
    after = 1 - before
    pole_a = gaps[index, index]
    has_b = index < n - 1
    pole_b = np.where(has_b, gaps[index, np.minimum(index + 1, n - 1)], 1.0)
    for _ in range(STEPS):
        away = gaps - x[:, None]
        term = weight / away
        slope = term / away
        psi, phi, dpsi, dphi = (np.einsum("ij,ij->i", m, side) for m in (term, slope) for side in (before, after))
        f = 1 + psi + phi
        below = f < 0
        low, high = np.where(below, x, low), np.where(below, high, x)
        open_ = (np.abs(f) > CLOSE * (1 - psi + phi)) & (high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            break
        # psi and phi as one pole each, equal to them in value and slope at x; the root of that, where it falls into the bracket.
        to_a, to_b = pole_a - x, pole_b - x
        q, t = dpsi * to_a**2, dphi * to_b**2
        c = 1 + psi - dpsi * to_a + phi - dphi * to_b
        # In y = distance from x: c (to_a - y)(to_b - y) + q (to_b - y) + t (to_a - y) = 0.
        b, k = c * (to_a + to_b) + q + t, c * to_a * to_b + q * to_b + t * to_a
        root = np.sqrt(np.maximum(b * b - 4 * c * k, 0))
        both = np.where(b >= 0, b + root, b - root)
        one = np.where(has_b, 2 * k / both, to_a + q / (1 + psi - dpsi * to_a))
        near = x + one
        new = np.where((near > low) & (near < high), near, x + both / (2 * c))
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        x = np.where(open_, new, x)
    return gaps, x


def rank_one(d: np.ndarray, q: np.ndarray, u: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of q diag(d) q' + rho u u', for ascending d, a full orthonormal q and rho >= 0."""
    z = u @ q
    length = float(z @ z)
    r = rho * length
    if not r > 8 * _EPS * float(np.abs(d).max()):
        return d, q
    d, z, q = d.copy(), z / np.sqrt(length), q.copy()
    moved = _deflate(d, z, q, r)
    poles = d[moved]
    # A turn may leave the poles out of order by rounding.
    order = np.argsort(poles, kind="stable")
    at = np.flatnonzero(moved)[order]
    poles, weight = poles[order], r * z[at] ** 2
    gaps, x = secular_roots(poles, weight)
    away = gaps - x[:, None]
    # The weights for which these roots are exact: so the vectors are orthogonal however close roots lie.
    between = poles[:, None] - poles
    np.fill_diagonal(between, 1.0)
    exact = np.sqrt(np.abs(np.prod(-away / between, axis=0)))
    turn = (np.where(z[at] < 0, -exact, exact) / away).T
    turn /= np.sqrt((turn**2).sum(axis=0))
    d[at] = poles - away[np.arange(len(at)), np.arange(len(at))]
    q[:, at] = q[:, at] @ turn
    order = np.argsort(d, kind="stable")
    return np.maximum(d[order], 0.0), q[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, mean, and the eigenvalues (ascending) and eigenvectors (columns) of the scatter around the mean."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width, np.int64), np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, rows: np.ndarray) -> None:
        """Rows of integers, one centred rank-one update each. Small ones lose least by rounding: see `padding` in `fit`."""
        self.sums = self.sums + rows.sum(axis=0)
        for row in rows.astype(np.float64):
            away = row - self.mean
            if self.n:
                self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """The other's eigenpairs and the distance of the means, one rank-one update each."""
        if not other.n:
            return
        n = self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        away = other.mean - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def record(self) -> dict:
        return {"n": self.n, "sums": self.sums.tolist(), "mean": self.mean.tolist(), "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        mean = np.array(row["mean"])
        return cls(row["n"], np.array(row["sums"], np.int64), mean, np.array(row["values"]), np.array(row["vectors"]).reshape(len(mean), len(mean)))


_SPECTRUM = "part bigint, n bigint, sums array<bigint>, mean array<double>, values array<double>, vectors array<double>"
_SQUARES = "part bigint, matrix array<double>"


def _one_row(record: dict, part: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part} | record], schema=schema)


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _reduced(rows: DataFrame, start: Callable, add: Callable, record: Callable, merge: Callable, schema: str) -> dict | None:
    """A record per task over its rows, then one of all: combined in groups of `FAN_IN`, level by level, on the executors."""
    from pyspark import TaskContext

    arrow = _arrow(schema, rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = start(), False
        for batch in batches:
            state, some = add(state, batch), some or batch.num_rows > 0
        if some:
            yield _one_row(record(state), TaskContext.get().partitionId(), arrow)

    def combine(table: pa.Table) -> pa.Table:
        states = table.sort_by("part").to_pylist()
        out = states[0]
        for other in states[1:]:
            out = merge(out, other)
        return pa.Table.from_batches([_one_row({k: v for k, v in out.items() if k != "part"}, states[0]["part"] // FAN_IN, arrow)])

    parts = checkpointed(rows.mapInArrow(run, schema))
    last = parts.agg(F.max("part")).first()[0]
    while last:
        parts = checkpointed(parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(combine, schema))
        last //= FAN_IN
    found = parts.collect()  # one record
    return found[0].asDict() if found else None


@dataclass(frozen=True)
class Whitening:
    """A fit: count, sums, eigenvalues (falling) and eigenvectors (columns) of the covariance, its trace and the error of the whitened covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    padding: int

    def centred(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """n x - sums as integers, and x less the mean."""
        exact = self.n * matrix(column, len(self.sums), self.padding) - self.sums
        return exact, exact / self.n

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values; 0 for components without variance."""
        positive = self.positive
        return (centred @ self.vectors) * np.where(positive, 1 / np.sqrt(np.where(positive, self.values, 1.0)), 0.0)

    @property
    def positive(self) -> np.ndarray:
        return self.values > 1e-13 * max(self.trace, 0.0)


def fit(rows: DataFrame, components: int, padding: int = 0) -> Whitening | None:
    """rows: integer vectors `vec`, without nulls, in a table that can be read repeatedly. None for an empty table.

    padding: stands for the entries that shorter vectors lack; the updates run on the differences from it, so a common shift of all entries costs no digits.
    """
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    if not width:
        return None

    def add(state: Spectrum, batch: pa.RecordBatch) -> Spectrum:
        state.add(matrix(batch.column("vec"), width, padding) - padding)
        return state

    def merged(a: dict, b: dict) -> dict:
        one = Spectrum.of(a)
        one.merge(Spectrum.of(b))
        return one.record()

    rough = Spectrum.of(_reduced(rows.select("vec"), lambda: Spectrum.empty(width), add, Spectrum.record, merged, _SPECTRUM))
    sums = rough.sums + rough.n * padding
    # Rounding turns the basis a little with every update; it is made orthonormal before the last pass.
    basis = np.linalg.qr(rough.vectors)[0]
    at_start = Whitening(rough.n, sums, np.ones(width), basis, float(width), 0.0, padding)

    def squares(model: Whitening) -> np.ndarray:
        """Covariance of the rows' values under the model."""

        def add(state: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            z = model.project(model.centred(batch.column("vec"))[1])
            return state + z.T @ z

        size = model.vectors.shape[1]
        total = _reduced(rows.select("vec"), lambda: np.zeros((size, size)), add, lambda s: {"matrix": s.ravel().tolist()}, lambda a, b: {"matrix": [x + y for x, y in zip(a["matrix"], b["matrix"])]}, _SQUARES)
        return np.array(total["matrix"]).reshape(size, size) / model.n

    inside = squares(at_start)
    values, turn = np.linalg.eigh((inside + inside.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    found = Whitening(rough.n, sums, np.maximum(values[order], 0.0), basis @ turn[:, order], float(np.trace(inside)), 0.0, padding)
    keep = found.positive
    error = np.abs(squares(found) - np.eye(len(order)))[np.ix_(keep, keep)]
    return Whitening(*(getattr(found, f) for f in ("n", "sums", "values", "vectors", "trace")), float(error.max(initial=0.0)), padding)


def whiten(vectors: DataFrame, components: int = 32, vector_col: str = "vec", padding: int = 0) -> DataFrame:
    """All columns of `vectors` and, for each row with a vector, `whitened` (array of up to `components` doubles), `deviation`, `n`, `explained` (array), `identity_error`.

    vector_col: integers (array of bigint). Rows whose vector is null or holds a null are dropped; shorter vectors count as padded with `padding`.
    `whitened`: the centred vector on each unit eigenvector of the covariance (divisor n), by falling eigenvalue, over the eigenvalue's root. Null for a component
    without variance, as of a single row or of equal ones; its `explained` is 0. `explained`: each component's share of the variance. `deviation`: sum over
    dimensions of (n x - sum)^2, exact, null where it is no bigint. `identity_error`: largest entry of the whitened values' covariance less the identity.
    Repeated rows count as often as they are there. An empty table gives an empty result. Columns of these names are replaced.
    """
    new = ["whitened", "deviation", "n", "explained", "identity_error"]
    kept = vectors.drop(*new).where(F.col(vector_col).isNotNull() & ~F.exists(F.coalesce(F.col(vector_col), F.array().cast("array<bigint>")), lambda x: x.isNull()))
    own = kept.columns
    held = written(kept.select(F.struct(*own).alias("own"), F.col(vector_col).cast("array<bigint>").alias("vec")), "vectors")
    model = fit(held, components, padding)
    fields = "whitened array<double>, deviation bigint, n bigint, explained array<double>, identity_error double"
    if model is None:  # no rows, or none with an entry
        n = held.count()
        empty = F.array().cast("array<double>")
        return held.select("own.*", empty.alias("whitened"), F.lit(0).cast("bigint").alias("deviation"), F.lit(n).cast("bigint").alias("n"), empty.alias("explained"), F.lit(0.0).alias("identity_error"))
    explained = (np.where(model.positive, model.values, 0.0) / (model.trace or 1.0)).tolist()
    silent = ~model.positive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, centred = model.centred(batch.column("vec"))
            white = model.project(centred)
            # In Python's integers where the sum of squares might not fit in 64 bits.
            if exact.size and float(np.abs(exact).max()) ** 2 * exact.shape[1] < 2**63:
                deviation = (exact**2).sum(axis=1).tolist()
            else:
                deviation = [s if (s := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in exact]
            flat = pa.array(white.ravel(), pa.float64(), mask=np.broadcast_to(silent, white.shape).ravel())
            starts = pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32())
            count = batch.num_rows
            columns = [batch.column("own"), pa.ListArray.from_arrays(starts, flat), pa.array(deviation, pa.int64()), pa.array([model.n] * count, pa.int64())]
            columns += [pa.array([explained] * count, pa.list_(pa.float64())), pa.array([model.identity_error] * count, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["own", *new])

    out = held.mapInArrow(run, f"own {held.schema['own'].dataType.simpleString()}, {fields}")
    return out.select("own.*", *new)
