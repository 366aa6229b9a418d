"""Projected quasi-Newton minimisation of the average distortion, and the objectives it evaluates.

The iterate and a few of its predecessors are NumPy blocks on the driver. The objective is either local (edge arrays
on the driver, for problems whose edges fit) or a Spark job per evaluation: edges stay packed in a table, the iterate
is broadcast (its size is checked), and tasks return their pulls summed by chunks of items, so the driver receives
one gradient, not one per task.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.kernels import Kernel
from filigree.session import materialize

log = logging.getLogger("filigree")
LOCAL_EDGES = 5_000_000
MAX_ITERATE_BYTES = 512_000_000
CHUNK = 1 << 16


class SolverError(Exception):
    pass


@dataclass
class SolveStats:
    average_distortions: list[float] = field(default_factory=list)
    residual_norms: list[float] = field(default_factory=list)
    step_percents: list[float] = field(default_factory=list)
    times: list[float] = field(default_factory=list)
    snapshots: list[tuple[int, np.ndarray]] = field(default_factory=list)
    iterations: int = 0
    solve_time: float = 0.0

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self.times)), self.average_distortions, self.residual_norms, self.step_percents, self.times))
        return spark.createDataFrame(rows, "iter int, avg_distortion double, residual_norm double, step_pct double, elapsed_s double")

    def snapshot_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, i, [float(v) for v in row]) for k, x in self.snapshots for i, row in enumerate(x)]
        return spark.createDataFrame(rows, "iter int, id bigint, x array<double>")

    def __str__(self) -> str:
        if not self.times:
            return "SolveStats: no iteration"
        return f"SolveStats: {self.iterations} iterations in {self.solve_time:.2f} s, average distortion {self.average_distortions[-1]:.6g}, residual norm {self.residual_norms[-1]:.3g}"


def evaluate(x, src, dst, w, kernel: Kernel, p: int) -> tuple[float, np.ndarray]:
    """Sum of distortions over p and its gradient, over edge arrays; in stretches that stay in the processor's cache."""
    cols = np.ascontiguousarray(x.T)
    total, g = 0.0, np.zeros_like(cols)
    step = max(1 << 15, len(x))
    for at in range(0, len(src), step):
        s, t, ws = src[at : at + step], dst[at : at + step], w[at : at + step]
        diff = [c.take(s) - c.take(t) for c in cols]
        d = diff[0] * diff[0]
        for v in diff[1:]:
            d += v * v
        np.sqrt(d, out=d)
        with np.errstate(all="ignore"):
            pull = kernel.slope(d, ws) / d
        pull[~np.isfinite(pull)] = 1.0
        pull /= p
        for k, v in enumerate(diff):
            v *= pull
            g[k] += np.bincount(s, v, len(x)) - np.bincount(t, v, len(x))
        total += float(kernel.value(d, ws).sum())
    return total / p, np.ascontiguousarray(g.T)


def weight_columns(kernel: Kernel) -> list[str]:
    return ["weight.deviation", "weight.weight"] if kernel.paired else ["weight"]


def weights(columns: np.ndarray) -> np.ndarray:
    """One weight a pair as a vector, pairs of them as two columns."""
    return columns[:, 0] if columns.shape[1] == 1 else columns


class LocalObjective:
    def __init__(self, src, dst, w, kernel: Kernel):
        self.src, self.dst, self.w, self.kernel = np.asarray(src, np.int64), np.asarray(dst, np.int64), np.asarray(w, float), kernel
        kernel.check(self.w)

    def __call__(self, x):
        return evaluate(x, self.src, self.dst, self.w, self.kernel, max(1, len(self.src)))


class SparkObjective:
    """edges (src, dst, weight) with item numbers 0..n-1, packed once."""

    def __init__(self, edges: DataFrame, kernel: Kernel, n: int, m: int):
        if n * m * 8 > MAX_ITERATE_BYTES:
            raise ValueError(f"an iterate of {n} x {m} is beyond what is broadcast; use descend() with tables")
        self.spark, self.kernel, self.n = edges.sparkSession, kernel, n

        def pack(batches):
            for b in batches:
                w = np.ascontiguousarray(b[[c for c in b.columns if c not in ("src", "dst")]].to_numpy(float))
                yield pd.DataFrame({"n": [len(b)], "src": [b["src"].to_numpy(np.int64).tobytes()], "dst": [b["dst"].to_numpy(np.int64).tobytes()], "w": [w.tobytes()]})

        self.blocks = materialize(edges.select("src", "dst", *weight_columns(kernel)).mapInPandas(pack, "n int, src binary, dst binary, w binary"))
        self.p = max(1, self.blocks.agg(F.sum("n")).first()[0] or 0)

    def __call__(self, x):
        shared, kernel, p = self.spark.sparkContext.broadcast(x), self.kernel, self.p

        def pulls(batches):
            x = shared.value
            total, value = np.zeros_like(x), 0.0
            for b in batches:
                for r in b.itertuples(index=False):
                    f, g = evaluate(x, np.frombuffer(r.src, np.int64), np.frombuffer(r.dst, np.int64), weights(np.frombuffer(r.w, float).reshape(r.n, -1)), kernel, p)
                    value += f
                    total += g
            yield pd.DataFrame({"chunk": [-1], "g": [np.array([value]).tobytes()]})
            for at in range(0, len(x), CHUNK):
                part = total[at : at + CHUNK]
                if part.any():
                    yield pd.DataFrame({"chunk": [at // CHUNK], "g": [np.ascontiguousarray(part).tobytes()]})

        def add(rows):
            return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "g": [sum(np.frombuffer(v, float) for v in rows["g"]).tobytes()]})

        parts = self.blocks.mapInPandas(pulls, "chunk int, g binary").groupBy("chunk").applyInPandas(add, "chunk int, g binary").collect()
        shared.destroy()
        g, value = np.zeros_like(x), 0.0
        for r in parts:
            v = np.frombuffer(r["g"], float)
            if r["chunk"] < 0:
                value = float(v[0])
            else:
                at = r["chunk"] * CHUNK
                g[at : at + CHUNK] = v.reshape(-1, x.shape[1])
        return value, g


def _cubic(a, fa, da, b, fb, db) -> float:
    """Minimiser of the cubic through two points with slopes, kept inside the middle nine tenths."""
    lo, hi = min(a, b), max(a, b)
    d1 = da + db - 3 * (fa - fb) / (a - b)
    root = d1 * d1 - da * db
    t = (lo + hi) / 2
    if root >= 0:
        d2 = np.sqrt(root) * np.sign(b - a)
        down = db - da + 2 * d2
        if down != 0:
            t = b - (b - a) * (db + d2 - d1) / down
    edge = 0.05 * (hi - lo)
    return float(min(max(t, lo + edge), hi - edge)) if np.isfinite(t) else (lo + hi) / 2


def _line_search(at, f0, d0, t, c1=1e-4, c2=0.9, evaluations=25):
    """A step that meets the strong Wolfe conditions, or the best one seen. at(t) gives (f, slope, ...)."""
    used = 0

    def call(t):
        nonlocal used
        used += 1
        return at(t)

    now = call(t)
    for _ in range(10):
        if np.isfinite(now[0]) and np.isfinite(now[1]):
            break
        t /= 2
        now = call(t)
    else:
        raise SolverError("the objective is not finite along the step")
    old = (0.0, f0, d0, None)
    low = high = None
    while used < evaluations:
        f, d = now[0], now[1]
        if f > f0 + c1 * t * d0 or (old[3] is not None and f >= old[1]):
            low, high = old, (t, f, d, now)
            break
        if abs(d) <= -c2 * d0:
            return t, now
        if d >= 0:
            low, high = (t, f, d, now), old
            break
        new = min(_cubic(old[0], old[1], old[2], t, f, d) if old[3] is not None else 2 * t, 10 * t)
        old, t = (t, f, d, now), max(new, 1.1 * t)
        now = call(t)
        if not np.isfinite(now[0]):
            return old[0], old[3]
    else:
        return (t, now) if now[0] <= f0 else (old[0], old[3])
    while used < evaluations and abs(high[0] - low[0]) > 1e-12 * max(1.0, abs(low[0])):
        t = _cubic(low[0], low[1], low[2], high[0], high[1], high[2])
        now = call(t)
        f, d = now[0], now[1]
        if not np.isfinite(f) or f > f0 + c1 * t * d0 or f >= low[1]:
            high = (t, f if np.isfinite(f) else low[1] + abs(low[1]) + 1, d if np.isfinite(d) else abs(d0), now)
        else:
            if abs(d) <= -c2 * d0:
                return t, now
            if d * (high[0] - low[0]) >= 0:
                high = low
            low = (t, f, d, now)
    return low[0], low[3]


def minimize(objective, constraint, x: np.ndarray, eps=1e-5, max_iter=300, memory_size=10, snapshot_every=None, print_every=None) -> tuple[np.ndarray, SolveStats]:
    """x minimised in the constraint, until the projected gradient's norm is at most eps."""
    if max_iter < 0 or memory_size <= 0:
        raise ValueError("max_iter must not be negative, memory_size must be positive")
    stats, began = SolveStats(), time.time()

    def value(z):
        f, g = objective(z)
        return f, constraint.tangent(z, g)

    x = constraint.project(x)
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for k in range(max_iter):
        size, norm = float(np.linalg.norm(x)), float(np.linalg.norm(g))
        if snapshot_every and k % snapshot_every == 0:
            stats.snapshots.append((k, x.copy()))
        if norm <= eps:
            break
        q, alphas = g.copy(), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * float((s * q).sum()))
            q -= alphas[-1] * y
        if pairs:
            s, y, rho = pairs[-1]
            q /= rho * float((y * y).sum())
        for (s, y, rho), a in zip(pairs, reversed(alphas)):
            q += s * (a - rho * float((y * q).sum()))
        slope = -float((g * q).sum())
        if slope >= 0:
            pairs, q = [], g.copy()
            slope = -norm * norm
        first = 1.0 if pairs else min(1.0, 1.0 / float(np.abs(g).sum()))

        def at(t, q=q):
            z = constraint.project(x - t * q)
            fz, gz = value(z)
            return fz, -float((gz * q).sum()), z, gz

        t, found = _line_search(at, f, slope, first)
        if found is None or found[0] > f:
            if not pairs:
                break
            pairs = []
            continue
        new, gn = found[2], found[3]
        s, y = new - x, gn - g
        sy = float((s * y).sum())
        if sy > 1e-10:
            pairs = [*pairs, (s, y, 1 / sy)][-memory_size:]
        stats.average_distortions.append(f)
        stats.residual_norms.append(norm)
        stats.step_percents.append(100 * float(np.linalg.norm(s)) / size if size else 0.0)
        stats.times.append(time.time() - began)
        if print_every and k % print_every == 0:
            log.info("iteration %d: distortion %.6g, residual %.3g", k, f, norm)
        x, f, g = new, found[0], gn
    stats.iterations, stats.solve_time = len(stats.times), time.time() - began
    stats.average_distortions.append(f)
    stats.residual_norms.append(float(np.linalg.norm(g)))
    stats.step_percents.append(0.0)
    stats.times.append(stats.solve_time)
    if snapshot_every:
        stats.snapshots.append((stats.iterations, x.copy()))
    return x, stats


def hessian_product(objective, constraint, x: np.ndarray):
    """v -> second derivative of the objective at x times v, both projected to the tangent space; v is a block like x.
    The gradient's central difference along v serves, which is exact for quadratics."""

    def product(v: np.ndarray) -> np.ndarray:
        v = constraint.tangent(x, v)
        h = 1e-4 * max(1.0, float(np.abs(x).max())) / max(float(np.abs(v).max()), 1e-300)
        return constraint.tangent(x, (objective(x + h * v)[1] - objective(x - h * v)[1]) / (2 * h))

    return product


def colours(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """A colour 0, 1, ... for each of n items, no two tied ones alike: each takes the first that its neighbours leave, so
    there is at most one more than the most neighbours of an item."""
    ends = np.r_[src, dst]
    order = np.argsort(ends, kind="stable")
    first, to, out = np.searchsorted(ends[order], np.arange(n + 1)), np.r_[dst, src][order], np.full(n, -1)
    for v in range(n):
        taken, c = set(out[to[first[v] : first[v + 1]]].tolist()), 0
        while c in taken:
            c += 1
        out[v] = c
    return out


def trace_estimate(product, shape: tuple[int, ...], queries: int = 10, seed: int = 0, colour: np.ndarray | None = None) -> float:
    """Trace of a symmetric operator on blocks of the given shape, by at most `queries` products.

    Where these allow one for each number, the trace is exact: the diagonal is read off products with unit blocks, one
    at a time, so memory stays that of a few blocks. colour: a number for each item (row); items of equal colour must not
    act on each other, and share a unit block. With fewer products it is exact on the range of a few products with random
    blocks, and estimated by random signs on the rest, a third for each step.
    """
    rng, each = np.random.default_rng(seed), max(1, queries // 3)
    size = int(np.prod(shape))
    of, width = (np.arange(shape[0]) if colour is None else np.asarray(colour)), size // max(1, shape[0])
    order = np.argsort(of, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if size else []
    if len(groups) * width <= queries:
        total, unit = 0.0, np.zeros((shape[0], width))
        for rows in groups:
            for k in range(width):
                unit[rows, k] = 1.0
                total += float(product(unit.reshape(shape)).reshape(unit.shape)[rows, k].sum())
                unit[rows, k] = 0.0
        return total
    apply = lambda cols: np.column_stack([product(c.reshape(shape)).ravel() for c in cols.T])
    each = min(each, size)
    basis = np.linalg.qr(apply(rng.choice([-1.0, 1.0], (size, each))))[0]
    rest = rng.choice([-1.0, 1.0], (size, each))
    rest -= basis @ (basis.T @ rest)
    return float((basis * apply(basis)).sum() + (rest * apply(rest)).sum() / each)


@dataclass(frozen=True)
class Stochastic:
    """A distortion of sampled pairs: sampler(batch size, generator) gives arrays src, dst, weight."""

    kernel: Kernel
    sampler: Callable[[int, np.random.Generator], tuple[np.ndarray, np.ndarray, np.ndarray]]
    batch_size: int
    name: str = "stochastic"


def minimize_stochastic(function: Stochastic, constraint, x, max_iter: int = 300, eps: float = 1e-5, memory_size: int = 10, inner: int = 20, seed: int = 0, snapshot_every=None):
    """Stochastic proximal rounds: each draws a batch of pairs and minimises its distortion plus a pull towards the last
    iterate that grows with the round, its size a tenth of the mean curvature after the first round (trace_estimate).
    Rounds end when an iterate moves by no more than eps of its size. A batch that cannot be solved is passed over."""
    rng, stats, began = np.random.default_rng(seed), SolveStats(), time.time()
    x, pull = constraint.project(x), 0.0
    for k in range(max_iter):
        if snapshot_every and k % snapshot_every == 0:
            stats.snapshots.append((k, x.copy()))
        local, last = LocalObjective(*function.sampler(function.batch_size, rng), function.kernel), x
        weight = pull * k / 2

        def near(z, local=local, last=last, weight=weight):
            f, g = local(z)
            return f + weight * float(((z - last) ** 2).sum()), g + 2 * weight * (z - last)

        try:
            x, _ = minimize(near, constraint, last, eps=eps, max_iter=inner, memory_size=memory_size)
        except SolverError as e:
            log.warning("round %d passed over: %s", k, e)
        if not np.isfinite(x).all():
            x = last
            break
        f, g = local(x)
        if k == 0:
            pull = max(0.0, trace_estimate(hessian_product(local, constraint, x), x.shape, seed=seed)) / x.size / 10
        moved = float(np.linalg.norm(x - last)) / max(float(np.linalg.norm(last)), 1e-300)
        stats.average_distortions.append(f)
        stats.residual_norms.append(float(np.linalg.norm(constraint.tangent(x, g))))
        stats.step_percents.append(100 * moved)
        stats.times.append(time.time() - began)
        if k and moved <= eps:
            break
    stats.iterations, stats.solve_time = len(stats.times), time.time() - began
    return x, stats


def descend(edges: DataFrame, points: DataFrame, kernel: Kernel, steps: int = 10, rate: float | None = None) -> DataFrame:
    """Centred gradient descent with everything in tables, for iterates too large to broadcast.

    Each step makes the gradient by joins (distances.gradient), tries a step, doubles the rate on success and halves
    it until the distortion falls. The driver sees two numbers a step.
    """
    from filigree.operators.distances import average_distortion, gradient
    from filigree.operators.transform import center

    now = materialize(center(points))
    f = average_distortion(edges, now, kernel).first()[0]
    rate = rate or 1.0 * max(1, now.count())
    for _ in range(steps):
        g = materialize(gradient(edges, now, kernel))
        for _ in range(12):
            moved = now.join(g, "id", "left")
            step = F.zip_with("x", "gradient", lambda a, b: a - rate * b)  # noqa: B023
            x = F.when(F.col("gradient").isNull(), F.col("x")).otherwise(step)
            trial = materialize(center(moved.select("id", x.alias("x"))))
            ft = average_distortion(edges, trial, kernel).first()[0]
            if ft is not None and np.isfinite(ft) and ft < f:
                now, f, rate = trial, ft, rate * 2
                break
            rate /= 2
        else:
            break
    return now
