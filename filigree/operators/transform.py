"""Whole-table transforms of an embedding (id, x): moments by one aggregate, then a map.

Only m x m matrices come to the driver, m being the number of coordinates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions import vectors as V


def _dims(points: DataFrame) -> int:
    row = points.select(F.size("x")).first()
    return row[0] if row else 0


def _at(k: int, col: str = "x"):
    return F.element_at(col, k + 1)


def _array(values):
    return F.array(*(F.lit(float(v)) for v in values))


def moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means, and X'X."""
    m = _dims(points)
    sums = [F.avg(_at(k)) for k in range(m)] + [F.sum(_at(a) * _at(b)) for a in range(m) for b in range(a, m)]
    row = points.agg(F.count("*"), *sums).first()
    mean = np.array(row[1 : m + 1], float)
    gram = np.zeros((m, m))
    for v, (a, b) in zip(row[m + 1 :], ((a, b) for a in range(m) for b in range(a, m))):
        gram[a, b] = gram[b, a] = v
    return row[0], mean, gram


def gram(points: DataFrame) -> DataFrame:
    """(a, b, value), a <= b: X'X over the number of rows."""
    m = _dims(points)
    sums = [(F.sum(_at(a) * _at(b)) / F.count("*")).alias(f"g_{a}_{b}") for a in range(m) for b in range(a, m)]
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"g_{a}_{b}").alias("value")) for a in range(m) for b in range(a, m)))
    return points.agg(*sums).select(F.explode(cells).alias("c")).select("c.*")


def center(points: DataFrame) -> DataFrame:
    m = _dims(points)
    means = points.agg(F.array(*(F.avg(_at(k)) for k in range(m))).alias("_mean"))
    return points.join(F.broadcast(means)).withColumn("x", V.minus(F.col("x"), F.col("_mean"))).drop("_mean")


def mapped(points: DataFrame, matrix: np.ndarray, shift: np.ndarray | None = None, offset: np.ndarray | None = None) -> DataFrame:
    """x becomes (x - shift) @ matrix + offset."""
    x = V.minus(F.col("x"), _array(shift)) if shift is not None else F.col("x")
    rows = points.withColumn("x", x)
    cols = [V.dot(F.col("x"), _array(matrix[:, k])) + float(0 if offset is None else offset[k]) for k in range(matrix.shape[1])]
    return rows.withColumn("x", F.array(*cols))


def standardize(points: DataFrame) -> DataFrame:
    """The nearest embedding with mean 0 and X'X/n = I: centred, times sqrt(n) (X'X)^(-1/2). Rank-deficient input
    raises ValueError."""
    n, mean, g = moments(points)
    values, vectors = np.linalg.eigh(g - n * np.outer(mean, mean))
    if not len(values) or values[0] <= 1e-12 * max(values[-1], 1e-300):
        raise ValueError("the coordinates are linearly dependent")
    return mapped(points, vectors @ np.diag(np.sqrt(n / values)) @ vectors.T, mean)


def procrustes(cross: np.ndarray) -> np.ndarray:
    """The orthogonal Q that brings the source nearest the target; cross = target' source."""
    u, _, vt = np.linalg.svd(cross)
    return vt.T @ u.T


def align(source: DataFrame, target: DataFrame) -> DataFrame:
    """source turned onto target: both centred and columns divided by their norms, the best rotation applied, then
    scaled and shifted back to the source. Rows are matched by id."""
    n, ms, gs = moments(source)
    t_n, mt, gt = moments(target)
    ns = np.sqrt(np.maximum(np.diag(gs) - n * ms**2, 0))
    nt = np.sqrt(np.maximum(np.diag(gt) - t_n * mt**2, 0))
    m = len(ms)
    both = source.select("id", "x").join(target.select("id", F.col("x").alias("y")), "id")
    sums = [F.sum((_at(a, "y") - float(mt[a])) * (_at(b) - float(ms[b]))) for a in range(m) for b in range(m)]
    cross = np.array(both.agg(*sums).first(), float).reshape(m, m) / np.outer(np.where(nt > 0, nt, 1), np.where(ns > 0, ns, 1))
    q = procrustes(cross)
    scale = np.where(ns > 0, ns, 1)
    return mapped(source, np.diag(1 / scale) @ q @ np.diag(scale), ms, ms)


def rotate(points: DataFrame, degrees) -> DataFrame:
    """Points of two or three coordinates turned by degrees (vectors.turned); others raise ValueError."""
    m = _dims(points)
    if m not in (2, 3) or (m == 2) != isinstance(degrees, (int, float)):
        raise ValueError("two coordinates take one angle, three take three")
    return points.withColumn("x", V.turned(F.col("x"), degrees))


def is_standardized(points: DataFrame, tolerance: float = 1e-4) -> bool:
    n, mean, g = moments(points)
    return bool(n and np.allclose(mean, 0, atol=tolerance) and np.allclose(g / n, np.eye(len(mean)), atol=tolerance))


def natural_length(n: int, m: int) -> float:
    """Root mean square distance of a standardized embedding."""
    return float(np.sqrt(2 * n * m / (n - 1)))


def pin(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """points with the anchors' vectors in place of their own; anchors: (id, x), one row per id."""
    a = anchors.select("id", F.col("x").alias("_x"))
    return points.join(a, "id", "left").withColumn("x", F.coalesce("_x", "x")).drop("_x")


def on_sphere(points: DataFrame, radius: float = 1.0) -> DataFrame:
    """Every point moved to the sphere along its ray; the origin stays."""
    size = V.norm(F.col("x"))
    return points.withColumn("x", F.when(size > 0, V.scaled(F.col("x"), F.try_divide(F.lit(float(radius)), size))).otherwise(F.col("x")))


def standard_scale(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; constant columns become 0."""
    stats = rows.agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(columns)))
    out = rows.join(F.broadcast(stats))
    for i, c in enumerate(columns):
        out = out.withColumn(c, F.when(F.col(f"_s{i}") > 0, (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(F.col(c) * 0.0))
    return out.drop(*(f"_{p}{i}" for p in "ms" for i in range(len(columns))))
