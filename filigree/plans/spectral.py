"""Principal components and spectral embeddings."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators.graph import Graph
from filigree.operators.transform import mapped
from filigree.plans.constraints import Standardized

DENSE_ITEMS = 1200


def feature_moments(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and X'X of (id, x), from partial sums of each task's batches (k x k to the driver)."""

    def part(batches):
        n, s, g = 0, 0.0, 0.0
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()).astype(float)
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        if n:
            yield pd.DataFrame({"k": [0], "n": [n], "s": [s.tobytes()], "g": [g.tobytes()]})

    def add(rows):
        tot = lambda c: sum(np.frombuffer(v, float) for v in rows[c]).tobytes()
        return pd.DataFrame({"k": [0], "n": [rows["n"].sum()], "s": [tot("s")], "g": [tot("g")]})

    schema = "k int, n bigint, s binary, g binary"
    row = items.select("x").mapInPandas(part, schema).groupBy("k").applyInPandas(add, schema).first()
    if row is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = np.frombuffer(row["s"], float) / row["n"]
    return row["n"], mean, np.frombuffer(row["g"], float).reshape(len(mean), -1)


def pca(items: DataFrame, m: int) -> DataFrame:
    """(id, x): sqrt(n) times the first m left singular vectors of the centred rows, signed so that each axis' largest
    loading is positive. m above min(n, features) raises ValueError."""
    n, mean, g = feature_moments(items)
    if m > min(n, len(mean)):
        raise ValueError("more components asked than there are rows or features")
    values, vectors = np.linalg.eigh(g - n * np.outer(mean, mean))
    values, vectors = values[::-1][:m], vectors[:, ::-1][:, :m]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(m)])
    scale = np.sqrt(n / np.where(values > 1e-12, values, np.inf))
    return mapped(items.select("id", F.col("x").cast("array<double>").alias("x")), vectors * scale, mean)


def smallest(times, degree: np.ndarray, count: int, seed: int = 0, max_iter: int = 400, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """The `count` smallest eigenpairs of a Laplacian given by its product: block conjugate directions (LOBPCG) with
    the degrees as preconditioner; the constant vector is known and kept out. If the residual is still above tol times
    the largest degree after max_iter rounds, a RuntimeWarning gives it."""
    n = len(degree)
    rng = np.random.default_rng(seed)
    one = np.full((n, 1), n**-0.5)
    clean = lambda v: v - one @ (one.T @ v)
    x = np.linalg.qr(clean(rng.standard_normal((n, min(n - 1, count + 4)))))[0]
    p = np.zeros((n, 0))
    scale = 1 / np.maximum(degree, 1e-12)[:, None]
    bound = tol * max(1.0, degree.max())
    for k in range(max_iter + 1):
        ax = times(x)
        r = ax - x * (x * ax).sum(axis=0)
        left = np.linalg.norm(r[:, :count], axis=0).max()
        if left <= bound:
            break
        if k == max_iter:
            warnings.warn(f"eigenvectors not converged: residual {left:.3g} above {bound:.3g} after {max_iter} rounds", RuntimeWarning, stacklevel=2)
            break
        basis = np.hstack([x, clean(scale * r), p])
        q, t = np.linalg.qr(basis)
        q = q[:, np.abs(np.diag(t)) > 1e-10 * np.abs(np.diag(t)).max()]
        w, v = np.linalg.eigh(q.T @ times(q))
        new = q @ v[:, : x.shape[1]]
        p = new - x @ (x.T @ new)
        norms = np.linalg.norm(p, axis=0)
        p = p[:, norms > 1e-12] / norms[norms > 1e-12]
        x = np.linalg.qr(clean(new))[0]
    w, v = np.linalg.eigh(x.T @ times(x))
    x = x @ v
    return w[:count], x[:, :count]


def spectral_block(src, dst, w, n: int, m: int, seed: int = 0, dense: int | None = None, max_iter: int = 400) -> np.ndarray:
    """(n, m) block: eigenvectors of the m smallest Laplacian eigenvalues after the first, centred and standardised."""
    degree = np.bincount(src, w, n) + np.bincount(dst, w, n)
    if n <= (DENSE_ITEMS if dense is None else dense):
        lap = np.diag(degree)
        np.subtract.at(lap, (src, dst), w)
        np.subtract.at(lap, (dst, src), w)
        x = np.linalg.eigh(lap)[1][:, 1 : m + 1]
    else:

        def times(v):
            out = degree[:, None] * v
            for k in range(v.shape[1]):
                out[:, k] -= np.bincount(src, w * v[dst, k], n) + np.bincount(dst, w * v[src, k], n)
            return out

        x = smallest(times, degree, m, seed, max_iter)[1]
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return Standardized().project(x)


def spectral_start(edges: DataFrame, n: int, m: int, seed: int = 0, local_edges: int | None = None, dense: int | None = None, max_iter: int = 400) -> np.ndarray:
    """spectral_block() of an edge table (src, dst, weight).

    Edges beyond local_edges stay in Spark: a product with the Laplacian is then half the number of edges times the
    gradient of the quadratic penalty, which is one job over packed edges; only blocks of n rows come to the driver.
    Both ways stop at the same residual or number of rounds.
    """
    from filigree.functions.kernels import quadratic
    from filigree.plans.solver import LOCAL_EDGES, SparkObjective

    if edges.count() <= (LOCAL_EDGES if local_edges is None else local_edges):
        e = edges.select("src", "dst", "weight").toPandas()
        return spectral_block(e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64), e["weight"].to_numpy(float), n, m, seed, dense, max_iter)
    product = SparkObjective(edges, quadratic(), n, 3 * (m + 4))
    degree = np.zeros(n)
    rows = Graph(edges, n).degrees().select("id", "strength").toPandas()
    degree[rows["id"].to_numpy(np.int64)] = rows["strength"].to_numpy()
    x = smallest(lambda v: product(np.ascontiguousarray(v))[1] * product.p / 2, degree, m, seed, max_iter)[1]
    return Standardized().project(x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(m)]))


def spectral(graph: Graph, m: int, seed: int = 0, method: str = "auto", max_iter: int = 400) -> DataFrame:
    """(id, x) of spectral_block(); of a graph in several parts, further null vectors are coordinates. method: "dense"
    decomposes the whole matrix, "iterative" runs at most max_iter rounds of conjugate directions, "auto" takes the
    former up to DENSE_ITEMS items."""
    if method not in ("auto", "dense", "iterative"):
        raise ValueError("method is 'auto', 'dense' or 'iterative'")
    dense = {"auto": None, "dense": graph.n_items, "iterative": 0}[method]
    return to_frame(graph.edges.sparkSession, spectral_start(graph.edges, graph.n_items, m, seed, dense=dense, max_iter=max_iter))


def to_frame(spark, x: np.ndarray) -> DataFrame:
    table = pd.DataFrame({"id": np.arange(len(x)), "x": [r.tolist() for r in x]})
    return spark.createDataFrame(table, "id bigint, x array<double>") if len(x) else spark.createDataFrame([], "id bigint, x array<double>")
