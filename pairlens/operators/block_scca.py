"""Sparse canonical weights of a very wide view, block by block, without a cross-covariance or a reduced basis.

The alternating steps of `solve.scca` are products with the blocks: u = S(X'Y v) and v = S(Y'X u). Nothing of the size of the features leaves
the tasks: a component's weights on a block follow from the block itself, the n scores Y v, a threshold and a length, so these are all that is shipped,
and earlier components are recomputed likewise where deflation needs them. The L1 threshold is a search over sums of |w| above
candidates, which tasks report. The subjects and the second view are narrow (`dual.Subjects`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.dual import Subjects, Subset, _residuals, _scales, _whole_blocks
from pairlens.operators.solve import l1_bound, l1_unit

CANDIDATES, ROUNDS = 255, 8  # thresholds tried in a job; each job narrows the range by their number


@dataclass
class Component:
    """What a task needs to recompute the weights u of one component on its blocks: scores Y v, deflation coefficients, threshold and length."""

    scores: np.ndarray
    deflate: np.ndarray
    threshold: float = 0.0
    length: float = 1.0


def _weights(z: np.ndarray, parts: list[Component]) -> np.ndarray:
    """u of every component on a block of prepared training rows (features x components)."""
    out = np.zeros((z.shape[1], len(parts)))
    for k, part in enumerate(parts):
        w = z.T @ part.scores / len(z) - out[:, : len(part.deflate)] @ part.deflate
        out[:, k] = np.sign(w) * np.maximum(np.abs(w) - part.threshold, 0) / part.length
    return out


@dataclass
class SparsePairs:
    """Fitted components: second-view weights (prepared features x k), correlations on training and scored rows, and variates; weights of the blocks by `table`."""

    v: np.ndarray
    r_train: np.ndarray
    r_score: np.ndarray
    variates_x: np.ndarray  # subset rows x k, training rows first
    variates_y: np.ndarray
    sparsity: np.ndarray  # share of zero weights per component
    iterations: list[int]
    converged: list[bool]
    table: Callable[[], DataFrame] = field(repr=False)


class _Blocks:
    """Prepared training blocks as the source of jobs."""

    def __init__(self, layout: DataFrame, subjects: Subjects, subset: Subset, standardize: bool) -> None:
        self.layout, self.n, self.c, self.subset, self.standardize = layout, subjects.n, subjects.c, subset, standardize

    def run(self, each: Callable[[str, np.ndarray, np.ndarray], Iterator[pa.RecordBatch] | None], done: Callable[[], Iterator[pa.RecordBatch]] | None, schema: str) -> DataFrame:
        """`each` gets every block's name and its prepared training and scored rows; `done` yields a task's sums."""
        n, c, subset, standardize = self.n, self.c, self.subset, self.standardize

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict = {}
            for name, x in _whole_blocks(batches, n):
                near = _residuals(x, c)
                coef, inverse = _scales(x, near, c, subset.train, standardize)
                got = each(state, name, (near[subset.train] - c[subset.train] @ coef) * inverse, lambda: (near[subset.score] - c[subset.score] @ coef) * inverse)
                if got is not None:
                    yield from got
            if done is not None and state:
                yield from done(state)

        return self.layout.mapInArrow(task, schema)

    def sums(self, each: Callable[[np.ndarray, Callable], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        """Sum over blocks of the named arrays that `each` gives; none grows with the features."""

        def add(state: dict, name: str, z: np.ndarray, scored: Callable) -> None:
            for key, value in each(z, scored).items():
                state[key] = state[key] + value if key in state else value

        def rows(state: dict) -> Iterator[pa.RecordBatch]:
            for key, value in state.items():
                flat = np.atleast_1d(np.asarray(value, float))
                if not flat.size:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * flat.size), pa.array(np.arange(flat.size)), pa.array([list(flat.shape)] * flat.size, pa.list_(pa.int32())), pa.array(flat.ravel())], names=["name", "at", "shape", "value"]
                )

        total = self.run(add, rows, "name string, at bigint, shape array<int>, value double").groupBy("name", "at", "shape").agg(F.sum("value").alias("value")).toPandas()
        out = {}
        for key, part in total.groupby("name"):
            flat = np.zeros(len(part))
            flat[part["at"].to_numpy()] = part["value"].to_numpy()
            out[key] = flat.reshape(tuple(part["shape"].iloc[0]))
        return out


def _above(held_weights: DataFrame, deflate: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Rows of count, sum and sum of squares of |w| above each candidate, and the largest |w| in the last row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, top = np.zeros((len(candidates), 3)), 0.0
        for batch in batches:
            for w0, before in zip(batch.column("w"), batch.column("before")):
                w = w0.values.to_numpy()
                if len(deflate):
                    w = w - before.values.to_numpy().reshape(len(w), -1) @ deflate
                mag = np.sort(np.abs(w))
                top = max(top, float(mag[-1]) if len(mag) else 0.0)
                first = np.searchsorted(mag, candidates, side="right")
                for column, power in enumerate((np.ones_like(mag), mag, mag**2)):
                    tail = np.concatenate([np.cumsum(power[::-1])[::-1], [0.0]])
                    total[:, column] += tail[first]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([top])], names=["sums", "top"])

    got = held_weights.mapInArrow(task, "sums array<double>, top double")
    cells = got.select("top", F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"), F.max("top").alias("top")).toPandas()
    out = np.zeros(3 * len(candidates))
    out[cells["at"].to_numpy()] = cells["value"].to_numpy()
    return np.vstack([out.reshape(-1, 3), [float(cells["top"].max()), 0, 0]])


def _closed(sums: np.ndarray, bound: float, paper: bool) -> float:
    """The threshold at which `sums` (count, sum and sum of squares of the weights above it) meet the bound."""
    count, total, squares = sums
    if not paper:
        return float((total - bound) / count)
    # (total - count x)^2 = bound^2 (squares - 2 x total + x^2 count): the smaller root leaves all of these weights.
    a, b, c = count * (count - bound**2), -2 * total * (count - bound**2), total**2 - bound**2 * squares
    return float((-b - np.sqrt(max(b * b - 4 * a * c, 0.0))) / (2 * a)) if a > 0 else float(total / count)


def _threshold(held_weights: DataFrame, deflate: np.ndarray, bound: float, paper: bool) -> tuple[float, float]:
    """Soft threshold that meets the L1 bound (see `solve.l1_unit`), and the L2 length of what is left."""

    def length(row: np.ndarray, lam: float) -> float:
        count, total, squares = row
        return float(np.sqrt(max(squares - 2 * lam * total + lam * lam * count, 0.0)))

    first = _above(held_weights, deflate, np.array([0.0]))
    (_, total, squares), top = first[0], float(first[1, 0])
    norm = float(np.sqrt(squares))
    if norm <= 1e-10:
        return 0.0, 1.0
    if (total / norm if paper else total) <= bound:
        return 0.0, norm
    low, high = 0.0, top
    for _ in range(ROUNDS):
        lams = np.linspace(low, high, CANDIDATES + 2)[1:-1]
        rows = _above(held_weights, deflate, lams)[:-1]
        left = rows[:, 1] - lams * rows[:, 0]
        size = np.array([length(row, lam) for row, lam in zip(rows, lams)])
        too_much = (np.where(size > 0, left / np.where(size > 0, size, 1.0), 0.0) if paper else left) > bound
        at = int(too_much.sum())  # the norm falls with the threshold
        # Between two candidates without a weight between them the same weights stay: the bound is met in closed form.
        below, above = rows[at - 1] if at else first[0], rows[at] if at < len(rows) else np.zeros(3)
        if below[0] == above[0] > 0:
            lam = _closed(below, bound, paper)
            return lam, length(below, lam) or 1.0
        low, high = (lams[at - 1] if at else low), (lams[at] if at < len(lams) else high)
        if high - low <= 1e-15 * top:
            break
    lam = low if paper else (low + high) / 2
    return lam, length(_above(held_weights, deflate, np.array([lam]))[0], lam) or 1.0


def block_scca(layout: DataFrame, subjects: Subjects, subset: Subset, k: int, c1: float, c2: float, projection: str = "raw", max_iter: int = 500, tol: float = 1e-6, standardize: bool = True) -> SparsePairs:
    """`solve.scca` (bound "interpolate") of the prepared blocks with the prepared second view, fitted on the subset's training rows.

    layout: of `dual.dual_layout`. Every iteration is two passes over the blocks and a few over the held block weights. Starts from the leading singular vector of the deflated
    cross-covariance, found from one more pass. Components that have not settled after `max_iter` steps are marked as such.
    """
    source = _Blocks(layout, subjects, subset, standardize)
    train, score = subset.train, subset.score
    near = _residuals(subjects.y, subjects.c)
    coef, inverse = _scales(subjects.y, near, subjects.c, train, standardize)
    y = (near[train] - subjects.c[train] @ coef) * inverse
    y_score = (near[score] - subjects.c[score] @ coef) * inverse
    n, q = y.shape
    p = int(layout.groupBy("block").agg(F.max(F.size("x")).alias("d")).agg(F.sum("d")).first()[0] or 0)
    b1, b2, paper = l1_bound(c1, p), l1_bound(c2, q), projection == "paper"

    def cross(z: np.ndarray, _: Callable) -> dict[str, np.ndarray]:
        own = z.T @ y / len(z)
        return {"square": own.T @ own}

    square = source.sums(cross)["square"]
    parts: list[Component] = []
    vs, scores_u, iterations, converged = np.zeros((q, k)), [], [], []
    gram = np.zeros((0, 0))

    def deflated_y(v: np.ndarray, done: int) -> np.ndarray:
        """B v of S B with B = (I - v1 v1')(I - v2 v2') ...; applied from the right, the last factor first."""
        for j in range(done - 1, -1, -1):
            v = v - vs[:, j] * (vs[:, j] @ v)
        return v

    for comp in range(k):
        deflate_y = np.column_stack([deflated_y(e, comp) for e in np.eye(q)])  # B
        if comp:
            own = list(parts)

            def inner(z: np.ndarray, _: Callable) -> dict[str, np.ndarray]:
                u = _weights(z, own)
                return {"uc": u.T @ (z.T @ y) / len(z), "uu": u.T @ u}

            got = source.sums(inner)
            uc, gram = got["uc"].reshape(comp, q), got["uu"].reshape(comp, comp)
            r = np.zeros((comp, q))  # A C = C - U r
            for j in range(comp):
                r[j] = uc[j] - gram[j, :j] @ r[:j]
            inside = square - uc.T @ r - r.T @ uc + r.T @ gram @ r
        else:
            inside = square
        v = np.linalg.eigh(deflate_y.T @ inside @ deflate_y)[1][:, -1]
        last: Component | None = None
        settled, step = False, 0
        for step in range(1, max_iter + 1):
            t = y @ (deflate_y @ v)
            own = list(parts)

            def raw(state: dict, name: str, z: np.ndarray, _: Callable) -> Iterator[pa.RecordBatch]:
                state["blocks"] = 1
                before = _weights(z, own)
                yield pa.RecordBatch.from_arrays([pa.array([(z.T @ t / len(z)).tolist()], pa.list_(pa.float64())), pa.array([before.ravel().tolist()], pa.list_(pa.float64()))], names=["w", "before"])

            weights = source.run(raw, None, "w array<double>, before array<double>").persist()
            dots = np.zeros(comp)
            if comp:
                dots = _dots(weights, comp)
            deflate = np.zeros(comp)
            for j in range(comp):
                deflate[j] = dots[j] - gram[j, :j] @ deflate[:j]
            lam, size = _threshold(weights, deflate, b1, paper)
            weights.unpersist()
            now = Component(t, deflate, lam, size)
            both = [*own, now]

            def onward(z: np.ndarray, _: Callable) -> dict[str, np.ndarray]:
                u = _weights(z, both)
                out = {"s": z @ u[:, comp], "dots": u[:, :comp].T @ u[:, comp], "own": u[:, comp] @ u[:, comp]}
                if last is not None:
                    out["turn"] = ((_weights(z, [*own, last])[:, comp] - u[:, comp]) ** 2).sum()
                return out

            got = source.sums(onward)
            s = got["s"]
            # X A' u: the earlier components' parts of u come off the scores.
            rest, away = got.get("dots", np.zeros(0)).reshape(comp), np.zeros(comp)
            for j in range(comp - 1, -1, -1):
                away[j] = rest[j] - gram[j, j + 1 :] @ away[j + 1 :]
            for j in range(comp):
                s = s - away[j] * scores_u[j]
            new = l1_unit(deflate_y.T @ (y.T @ s / n), b2, paper)
            moved_u = float(np.sqrt(got["turn"][0])) if "turn" in got else float(np.sqrt(got["own"][0]))
            settled = max(moved_u, float(np.linalg.norm(new - v)) if last is not None else np.inf) < tol
            v, last = new, now
            if settled:
                break
        parts.append(last)
        vs[:, comp] = v
        scores_u.append(got["s"])
        iterations.append(step)
        converged.append(settled)
    final = list(parts)

    def variates(z: np.ndarray, scored: Callable) -> dict[str, np.ndarray]:
        u = _weights(z, final)
        return {"x": np.vstack([z @ u, scored() @ u]), "zero": (np.abs(u) < 1e-12).sum(axis=0).astype(float)}

    got = source.sums(variates)
    sign = _signs(source, final)
    x, vs = got["x"] * sign, vs * sign
    other = np.vstack([y, y_score]) @ vs

    def correlations(rows: slice) -> np.ndarray:
        a, b = x[rows] - x[rows].mean(axis=0), other[rows] - other[rows].mean(axis=0)
        den = np.sqrt((a**2).sum(axis=0) * (b**2).sum(axis=0))
        return np.where(den > 0, (a * b).sum(axis=0) / np.where(den > 0, den, 1.0), np.nan)

    def table() -> DataFrame:
        def rows(state: dict, name: str, z: np.ndarray, _: Callable) -> Iterator[pa.RecordBatch]:
            u = _weights(z, final) * sign
            d, m = u.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (d * m)), pa.array(np.repeat(np.arange(d, dtype=np.int32), m)), pa.array(np.tile(np.arange(m, dtype=np.int32), d)), pa.array(u.ravel())], names=["block", "dim", "component", "weight"]
            )

        return source.run(rows, None, "block string, dim int, component int, weight double")

    r_score = correlations(slice(n, None)) if len(score) else np.full(k, np.nan)
    return SparsePairs(vs, correlations(slice(0, n)), r_score, x, other, got["zero"] / max(p, 1), iterations, converged, table)


def _dots(weights: DataFrame, comp: int) -> np.ndarray:
    """Inner products of the earlier components' weights with w, over all blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(comp)
        for batch in batches:
            for w, before in zip(batch.column("w"), batch.column("before")):
                total += before.values.to_numpy().reshape(-1, comp).T @ w.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(comp, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    got = weights.mapInArrow(task, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(comp)
    for r in got:
        out[r["at"]] = r["value"]
    return out


def _signs(source: _Blocks, parts: list[Component]) -> np.ndarray:
    """Sign of every component's largest |weight|: the convention of `solve.fix_signs`."""

    def largest(state: dict, name: str, z: np.ndarray, _: Callable) -> Iterator[pa.RecordBatch]:
        u = _weights(z, parts)
        top = np.abs(u).argmax(axis=0)
        value = u[top, np.arange(u.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(u.shape[1], dtype=np.int32)), pa.array(value)], names=["component", "value"])

    got = source.run(largest, None, "component int, value double").groupBy("component").agg(F.max_by("value", F.abs("value")).alias("value")).collect()
    out = np.ones(len(parts))
    for r in got:
        out[r["component"]] = -1.0 if r["value"] < 0 else 1.0
    return out
