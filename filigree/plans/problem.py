"""A minimum-distortion embedding problem over an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.kernels import Kernel
from filigree.operators import diagnostics, distances
from filigree.operators.pairs import n_pairs, numbered
from filigree.plans.constraints import Anchored, Centered, Constraint
from filigree.plans.solver import LOCAL_EDGES, LocalObjective, SparkObjective, Stochastic, minimize, minimize_stochastic, weight_columns, weights
from filigree.plans.spectral import to_frame
from filigree.session import materialize


class MDE:
    """edges: (src, dst, weight), ids 0..n_items-1; weight is the kernel's weight or deviation (or a struct of both, if
    it is paired).

    Self edges and more edges than pairs raise ValueError. edges may be None only with a Stochastic, which samples its
    own; then embed() needs no batch size, and there is nothing to measure on all edges.
    """

    def __init__(self, n_items: int, embedding_dim: int, edges: DataFrame | None, kernel: Kernel | Stochastic, constraint: Constraint | None = None, initial: np.ndarray | None = None):
        self.n_items, self.embedding_dim, self.kernel = n_items, embedding_dim, kernel
        self.edges, self.constraint, self.initial = edges, constraint or Centered(), initial
        self.X: DataFrame | None = None
        self.block: np.ndarray | None = None
        self.stats = None
        self.value = self.residual_norm = None
        if edges is None:
            if not isinstance(kernel, Stochastic):
                raise ValueError("without edges the function must be a Stochastic")
            self.spark, self.p = SparkSession.getActiveSession(), 0
            return
        self.spark = edges.sparkSession
        loops = edges.where("src = dst").limit(5).collect()
        if loops:
            raise ValueError(f"self edges: {[(r['src'], r['dst']) for r in loops]}")
        self.p = edges.count()
        if self.p > n_pairs(n_items):
            raise ValueError(f"{self.p} edges, but {n_items} items have {n_pairs(n_items)} pairs")

    def __str__(self) -> str:
        return f"MDE of {self.n_items} items in {self.embedding_dim} dimensions, {self.p} edges, {self.kernel.name}, {self.constraint.name}"

    def _arrays(self, edges: DataFrame | None = None):
        """Columns of the edges (at most LOCAL_EDGES, or a batch of about the size asked)."""
        e = (self.edges if edges is None else edges).select("src", "dst", *weight_columns(self.kernel)).toArrow()
        w = np.column_stack([e.column(k).to_numpy().astype(float) for k in range(2, e.num_columns)])
        return e["src"].to_numpy().astype(np.int64), e["dst"].to_numpy().astype(np.int64), weights(w)

    def _batches(self, size: int, seed: int) -> Stochastic:
        """Batches of the problem's own edges: drawn from arrays, or, where there are too many for the driver, parts of
        a table cut by a hash, in turn."""
        if self.p <= LOCAL_EDGES:
            src, dst, w = self._arrays()

            def draw(n, rng):
                pick = rng.choice(len(src), size=min(n, len(src)), replace=False)
                return src[pick], dst[pick], w[pick]

            return Stochastic(self.kernel, draw, size)
        parts, turn = -(-self.p // size), iter(range(1 << 60))
        part = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(parts)).cast("int")
        cut = materialize(self.edges.withColumn("_part", part).repartition("_part").sortWithinPartitions("_part"))
        return Stochastic(self.kernel, lambda n, rng: self._arrays(cut.where(F.col("_part") == next(turn) % parts)), size)

    def objective(self, local: bool | None = None):
        local = self.p <= LOCAL_EDGES if local is None else local
        if local:
            return LocalObjective(*self._arrays(), self.kernel)
        return SparkObjective(self.edges, self.kernel, self.n_items, self.embedding_dim)

    def embed(self, X=None, eps=1e-5, max_iter=300, memory_size=10, print_every=None, snapshot_every=None, seed=0, local=None, batch_size=None) -> DataFrame:
        """(id, x). X: a block or table to start from; batch_size: stochastic rounds on so many edges each."""
        if isinstance(X, DataFrame):
            rows = X.orderBy("id").toPandas()
            X = np.stack(rows["x"].to_numpy()).astype(float)
        rng = np.random.default_rng(seed)
        start = X if X is not None else self.initial if self.initial is not None else self.constraint.initial(self.n_items, self.embedding_dim, rng)
        if batch_size or self.edges is None:
            function = self.kernel if self.edges is None else self._batches(batch_size, seed)
            self.block, self.stats = minimize_stochastic(function, self.constraint, start, max_iter, eps, memory_size, seed=seed, snapshot_every=snapshot_every)
        else:
            self.block, self.stats = minimize(self.objective(local), self.constraint, start, eps, max_iter, memory_size, snapshot_every, print_every)
        self.value, self.residual_norm = self.stats.average_distortions[-1], self.stats.residual_norms[-1]
        self.X = to_frame(self.spark, self.block)
        return self.X

    def _points(self, X: DataFrame | None) -> DataFrame:
        if X is None and self.X is None:
            raise ValueError("embed first, or give an embedding")
        return self.X if X is None else X

    def differences(self, X=None) -> DataFrame:
        return distances.differences(self.edges, self._points(X))

    def distances(self, X=None) -> DataFrame:
        return distances.with_distance(self.edges, self._points(X))

    def distortions(self, X=None) -> DataFrame:
        return distances.distortions(self.edges, self._points(X), self.kernel)

    def average_distortion(self, X=None) -> float:
        return distances.average_distortion(self.edges, self._points(X), self.kernel).first()[0]

    def high_distortion_pairs(self, X=None, count=None) -> DataFrame:
        return diagnostics.extreme_pairs(self.distortions(X), count)

    def distortions_cdf(self, X=None) -> DataFrame:
        return diagnostics.cdf(self.distortions(X))

    def solve_stats(self) -> DataFrame:
        return self.stats.frame(self.spark)

    def snapshots(self) -> DataFrame:
        return self.stats.snapshot_frame(self.spark)

    def plot_frame(self, attributes=None, edges=False):
        return diagnostics.plot_frame(self.X, attributes, self.edges if edges else None)


def anchored(anchors: DataFrame) -> Anchored:
    rows = anchors.where("id IS NOT NULL").dropDuplicates(["id"]).orderBy("id").toPandas()
    return Anchored(rows["id"].to_numpy(np.int64), np.stack(rows["x"].to_numpy()).astype(float))


def indexed_items(items: DataFrame, id_column: str = "id") -> DataFrame:
    """items plus idx, 0..n-1 in id order, for the dense solver."""
    return numbered(items, id_column)
