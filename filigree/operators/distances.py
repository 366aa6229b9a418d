"""Distances of pairs by features or embedding, distortions, and the gradient as joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import vectors as V
from filigree.functions.kernels import Kernel
from filigree.operators import pairs as P
from filigree.operators.knn import tiles


def gather(edges: DataFrame, points: DataFrame) -> DataFrame:
    """edges plus xi and xj, the vectors of both ends (points: id, x). Edges with an end without a point are dropped.

    Two equi-joins; Catalyst broadcasts points where its size allows and shuffles by the ends otherwise.
    """
    a = points.select(F.col("id").alias("src"), F.col("x").alias("xi"))
    b = points.select(F.col("id").alias("dst"), F.col("x").alias("xj"))
    return edges.join(a, "src").join(b, "dst")


def differences(edges: DataFrame, points: DataFrame) -> DataFrame:
    return gather(edges, points).withColumn("diff", V.minus(F.col("xi"), F.col("xj"))).drop("xi", "xj")


def with_distance(edges: DataFrame, points: DataFrame) -> DataFrame:
    """edges plus column distance."""
    return gather(edges, points).withColumn("distance", V.distance(F.col("xi"), F.col("xj"))).drop("xi", "xj")


def _all_in_tile(batches):
    for t in batches:
        for r in t.itertuples(index=False):
            a, b = np.asarray(r.a_ids), np.asarray(r.b_ids)
            x, y = np.asarray(r.a_x).reshape(len(a), -1), np.asarray(r.b_x).reshape(len(b), -1)
            for at in range(0, len(a), 256):
                rows = slice(at, at + 256)
                sizes = (x[rows] ** 2).sum(1)[:, None] + (y**2).sum(1)[None, :]
                d2 = np.maximum(sizes - 2.0 * (x[rows] @ y.T), 0)
                i, j = np.nonzero(a[rows][:, None] < b[None, :]) if r.a == r.b else np.indices(d2.shape).reshape(2, -1)
                d = np.sqrt(d2[i, j])
                near = d2[i, j] < 1e-6 * sizes[i, j]  # the product form cancels there
                d[near] = np.sqrt(((x[rows][i[near]] - y[j[near]]) ** 2).sum(axis=1))
                p, q = a[rows][i], b[j]
                keep = d > 0
                yield pd.DataFrame({"src": np.minimum(p, q)[keep], "dst": np.maximum(p, q)[keep], "distance": d[keep]})


def pairwise(spark: SparkSession, items: DataFrame, retain_fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """(src, dst, distance) of all pairs of items (id 0..n-1, x), or of a uniform sample of int(fraction * pairs).

    Pairs at distance zero are left out. retain_fraction <= 0 raises ValueError. All pairs come from tiles of item
    blocks; a full result has n(n-1)/2 rows by its nature, which recipes cap by sampling before any distance is made.
    """
    if retain_fraction <= 0:
        raise ValueError("retain_fraction must be positive")
    if retain_fraction >= 1:
        return tiles(items, 512).mapInPandas(_all_in_tile, "src bigint, dst bigint, distance double")
    n = items.count()
    edges = P.sample_edges(spark, n, int(retain_fraction * P.n_pairs(n)), seed=seed)
    return with_distance(edges, items).where("distance <> 0")


def distortions(edges: DataFrame, points: DataFrame, kernel: Kernel, weight: str = "weight") -> DataFrame:
    """edges plus distance and distortion."""
    return with_distance(edges, points).withColumn("distortion", kernel.column(F.col("distance"), F.col(weight)))


def average_distortion(edges: DataFrame, points: DataFrame, kernel: Kernel, weight: str = "weight") -> DataFrame:
    """One row: the mean distortion."""
    return distortions(edges, points, kernel, weight).agg(F.avg("distortion").alias("average_distortion"))


def gradient(edges: DataFrame, points: DataFrame, kernel: Kernel, weight: str = "weight") -> DataFrame:
    """(id, gradient) of the mean distortion: each edge sends its pull to both ends, summed with map-side combining.

    Where the slope over the distance is no finite number (coincident ends), it counts as 1, times a difference of
    zero. Items without edges have no row; edges with an end without a point do not count.
    """
    dims = points.select(F.size("x")).first()
    dims = dims[0] if dims else 0
    rows = gather(edges, points)
    ids = points.select("id").distinct()
    count = max(1, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").count())
    d = V.distance(F.col("xi"), F.col("xj"))
    pull = F.when(F.col("_d") > 0, kernel.slope_column(F.col("_d"), F.col(weight)) / F.col("_d"))
    rows = rows.withColumn("_d", d).withColumn("_g", pull)
    rows = rows.withColumn("_g", F.when(F.col("_g").isNull() | F.isnan("_g") | (F.abs("_g") == float("inf")), 1.0).otherwise(F.col("_g")) / count)
    diff = V.minus(F.col("xi"), F.col("xj"))
    ends = F.array(
        F.struct(F.col("src").alias("id"), V.scaled(diff, F.col("_g")).alias("v")),
        F.struct(F.col("dst").alias("id"), V.scaled(diff, -F.col("_g")).alias("v")),
    )
    flat = rows.select(F.explode(ends).alias("e")).select("e.id", "e.v")
    sums = flat.groupBy("id").agg(*(F.sum(F.element_at("v", k + 1)).alias(f"g{k}") for k in range(dims)))
    return sums.select("id", F.array(*(F.col(f"g{k}") for k in range(dims))).alias("gradient") if dims else F.array().cast("array<double>").alias("gradient"))
