"""Problems from data: keep neighbours, keep distances, Laplacian embedding, graph drawing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions import kernels as K
from filigree.operators import knn as N
from filigree.operators import pairs as P
from filigree.operators.distances import pairwise
from filigree.operators.graph import Graph, radius, scale
from filigree.operators.paths import graph_knn, shortest_paths
from filigree.operators.transform import natural_length
from filigree.plans.constraints import Anchored, Centered, Constraint, Standardized
from filigree.plans.problem import MDE
from filigree.plans.spectral import spectral_start
from filigree.session import materialize


def default_neighbours(n: int) -> int:
    return int(max(min(15, P.n_pairs(n) * 0.01 / n), 5))


def _anchor_filter(edges: DataFrame, constraint: Constraint) -> DataFrame:
    if not isinstance(constraint, Anchored):
        return edges
    ids = edges.sparkSession.createDataFrame([(int(i),) for i in constraint.anchors], "id bigint")
    return P.without_anchored(edges, ids)


def neighbour_graph(data: DataFrame | Graph, k: int, max_distance: float | None = None, probes: int | None = None, approximate: bool = False) -> DataFrame:
    """Edges weighted 1 or 2 of a data matrix (id 0..n-1, x) or graph. Neighbours are exact at every size, unless
    approximate (or probes) asks for near lists."""
    if isinstance(data, Graph):
        return graph_knn(data, k, max_distance)
    if approximate or probes is not None:
        near = N.knn_approximate(data, k, min(4096, max(1, int(math.sqrt(data.count())))), probes)
    else:
        near = N.knn(data, k)
    return N.knn_edges(near, max_distance)


def _coincide(edges: DataFrame, start: np.ndarray) -> bool:
    """Whether the ends of any edge start at the same place."""
    shared = edges.sparkSession.sparkContext.broadcast(start)

    def same(batches):
        x = shared.value
        for b in batches:
            yield b.loc[(x[b["src"].to_numpy()] == x[b["dst"].to_numpy()]).all(axis=1), ["src"]]

    return bool(edges.select("src", "dst").mapInPandas(same, "src bigint").limit(1).count())


def preserve_neighbors(
    data: DataFrame | Graph, embedding_dim: int = 2, attractive: K.Kernel | None = None, repulsive: K.Kernel | None | str = "default",
    constraint: Constraint | None = None, n_neighbors: int | None = None, repulsive_fraction: float | None = None,
    max_distance: float | None = None, init: str = "quadratic", seed: int = 0, approximate: bool = False,
) -> MDE:
    """Neighbours pull, sampled non-neighbours push.

    data: items (id 0..n-1, x) or a Graph. Defaults: log1p pulls, log pushes (None: nothing pushes, and the constraint
    is Standardized), as many pushing pairs as edges (half as many if standardized), start "quadratic" (spectral) or
    "random". A graph's neighbours lie within three times the upper quartile of its weights. approximate: an item
    matrix' neighbours come from near lists (knn_approximate), with a loss.
    """
    attractive = attractive or K.log1p()
    repulsive = K.log() if repulsive == "default" else repulsive
    if init not in ("quadratic", "random"):
        raise ValueError("init is 'quadratic' or 'random'")
    graph = isinstance(data, Graph)
    n = data.n_items if graph else data.count()
    if n <= 1:
        raise ValueError("at least two items are needed")
    k = n_neighbors or default_neighbours(n)
    k = n - 1 if k >= n else k
    constraint = constraint or (Centered() if repulsive is not None else Standardized())
    if graph and max_distance is None:
        max_distance = radius(data.edges).first()[0]
    edges = materialize(_anchor_filter(neighbour_graph(data, k, max_distance, approximate=approximate), constraint))
    rng = np.random.default_rng(seed)
    if init == "quadratic":
        start = spectral_start(edges, n, embedding_dim, seed)
        if not isinstance(constraint, (Centered, Standardized)):
            start = constraint.project(start)
    else:
        start = constraint.initial(n, embedding_dim, rng)
    kernel = attractive
    if repulsive is not None:
        have = edges.count()
        share = repulsive_fraction if repulsive_fraction is not None else 0.5 if isinstance(constraint, Standardized) else 1.0
        many = min(int(share * have), P.n_pairs(n) - have)
        push = P.sample_edges(edges.sparkSession, n, many, edges, seed)
        push = _anchor_filter(push.withColumn("weight", F.lit(-1.0)), constraint)
        edges = materialize(edges.unionByName(push))
        kernel = K.push_and_pull(attractive, repulsive)
    if _coincide(edges, start):
        start = start + 1e-4 * rng.standard_normal(start.shape)
    return MDE(n, embedding_dim, edges, kernel, constraint, start)


def original_distances(data: DataFrame | Graph, retain_fraction: float = 1.0, seed: int = 0) -> Graph:
    """The graph of original distances: Euclidean between items (id 0..n-1, x), path lengths in a Graph; or of a sample
    of that share of the pairs."""
    if isinstance(data, Graph):
        return shortest_paths(data, None, retain_fraction, seed)
    edges = pairwise(data.sparkSession, data, retain_fraction, seed).withColumnRenamed("distance", "weight")
    return Graph(edges.select("src", "dst", "weight"), data.count())


def preserve_distances(data: DataFrame | Graph, embedding_dim: int = 2, loss: K.Kernel | None = None, constraint: Constraint | None = None, max_distances: float = 5e7, seed: int = 0) -> MDE:
    """Embedding distances near the original ones; at most about max_distances pairs are sampled."""
    loss, constraint = loss or K.loss_absolute(), constraint or Centered()
    graph = isinstance(data, Graph)
    n = data.n_items if graph else data.count()
    if n <= 1:
        raise ValueError("at least two items are needed")
    share = min(1.0, max_distances / P.n_pairs(n))
    edges = materialize(original_distances(data, share, seed).edges)
    if isinstance(constraint, Standardized):
        edges = materialize(scale(edges, "weight", natural_length(n, embedding_dim)))
    edges = _anchor_filter(edges, constraint)
    return MDE(n, embedding_dim, edges, loss, constraint)


def laplacian_embedding(data: DataFrame | Graph, embedding_dim: int = 2, n_neighbors: int | None = None, max_distance: float | None = None, seed: int = 0, approximate: bool = False) -> MDE:
    """Quadratic pull only, standardized."""
    return preserve_neighbors(data, embedding_dim, K.quadratic(), None, Standardized(), n_neighbors, None, max_distance, seed=seed, approximate=approximate)


def draw(graph: Graph, embedding_dim: int = 2, standardized: bool = False, seed: int = 0) -> MDE:
    """A layout of a graph by path lengths, sampled to about 1e7 pairs. Negative weights raise ValueError."""
    if graph.edges.where("weight < 0").limit(1).count():
        raise ValueError("weights must not be negative")
    share = min(1.0, 1e7 / max(1, P.n_pairs(graph.n_items)))
    lengths = materialize(graph.edges if graph.n_edges() == graph.n_all_edges() else shortest_paths(graph, None, share, seed).edges)
    if standardized:
        edges = lengths.withColumn("weight", 1 / F.col("weight"))
        return MDE(graph.n_items, embedding_dim, edges, K.cubic(), Standardized())
    return MDE(graph.n_items, embedding_dim, lengths, K.loss_weighted_quadratic(), Centered())
