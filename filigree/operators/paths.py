"""Shortest paths between all pairs of a graph, and neighbours by path length.

Where the edges fit a broadcast (checked), sources are spread over tasks and searched on arrays, whole frontiers at a
time; neighbours by path end their search at the k-th. Beyond that, distance tables are relaxed by joins until nothing
shrinks. Spanning forests come from forests of ever larger parts of the edges.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.distances import _all_in_tile
from filigree.operators.graph import Graph
from filigree.operators.knn import tiles
from filigree.session import materialize, release

BROADCAST_EDGES = 20_000_000
HELD_EDGES = 1 << 20
LAST_EDGES = 4_000_000


class Search:
    """Searches over adjacency arrays: first[v]..first[v+1] are the places of v's neighbours in `to` and `cost`."""

    def __init__(self, first: np.ndarray, to: np.ndarray, cost: np.ndarray, unit: bool):
        self.first, self.to, self.cost, self.unit = first, to, cost, unit
        self.dist, self.before = np.full(len(first) - 1, np.inf), np.full(len(first) - 1, -1)

    def _out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all neighbours of the nodes, and whose they are."""
        n = self.first[nodes + 1] - self.first[nodes]
        whose = np.repeat(nodes, n)
        return np.arange(len(whose)) + np.repeat(self.first[nodes] - np.cumsum(n) + n, n), whose

    def reach(self, source: int, limit: float = np.inf, predecessors: bool = False):
        """Nodes reached from source within limit, and their distances (and the node before each, the smallest of
        equals, if asked). Whole frontiers are relaxed at a time; with unit costs each node is reached once."""
        dist, touched, front = self.dist, [np.array([source])], np.array([source])
        dist[source] = 0.0
        while len(front):
            place, whose = self._out(front)
            to, d = self.to[place], dist[whose] + self.cost[place]
            better = (d < dist[to]) & (d <= limit)
            to, d = to[better], d[better]
            np.minimum.at(dist, to, d)
            front = np.unique(to)
            touched.append(front)
        nodes = np.unique(np.concatenate(touched))
        nodes = nodes[nodes != source]
        found = dist[nodes].copy()
        if predecessors:
            every = np.r_[source, nodes]
            place, whose = self._out(every)
            tight = dist[whose] + self.cost[place] == dist[self.to[place]]
            before = np.full(len(dist), np.iinfo(np.int64).max)
            np.minimum.at(before, self.to[place[tight]], whose[tight])
        dist[nodes] = dist[source] = np.inf
        return (nodes, found, before[nodes]) if predecessors else (nodes, found)

    def nearest(self, source: int, k: int, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest nodes within limit, ties by id: the search ends with the k-th distance."""
        done: dict[int, float] = {}
        queue = [(0.0, source)]
        while queue:
            d, v = heapq.heappop(queue)
            if v in done:
                continue
            if len(done) > k and d > last:
                break
            done[v] = last = d
            lo, hi = self.first[v], self.first[v + 1]
            for w, c in zip(self.to[lo:hi].tolist(), self.cost[lo:hi].tolist()):
                if w not in done and d + c <= limit:
                    heapq.heappush(queue, (d + c, w))
        done.pop(source)
        nodes, d = np.fromiter(done.keys(), np.int64, len(done)), np.fromiter(done.values(), float, len(done))
        best = np.lexsort((nodes, d))[:k]
        return nodes[best], d[best]


# Fixed values of the hash that samples pairs; it is the same on arrays and in SQL.
_PRIME, _A, _B, _C, _D = 2**31 - 1, 48271, 69621, 40692, 16807


def _chance(src, dst, seed: int):
    """A number below _PRIME for each pair (arrays or columns)."""
    h = (src * _A + dst * _B + (seed * _C + 11)) % _PRIME
    g = (h * h + _D) % _PRIME
    return (g * g + h) % _PRIME


def _kept(pairs: DataFrame, share: float, seed: int) -> DataFrame:
    if share >= 1:
        return pairs
    return pairs.where(_chance(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), seed) < int(share * _PRIME))


def shortest_paths(graph: Graph, max_length: float | None = None, retain_fraction: float = 1.0, seed: int = 0, broadcast_edges: int = BROADCAST_EDGES) -> Graph:
    """The graph whose weights are path lengths: pairs src < dst that are reachable within max_length.

    retain_fraction keeps pairs by a hash of their ends. Negative weights raise ValueError. All pairs are quadratic
    in number by nature; give max_length or retain_fraction to bound them.
    """
    edges = materialize(graph.edges)
    limit = float("inf") if max_length is None else float(max_length)
    arrays = adjacency(edges, broadcast_edges)
    if arrays is None:
        return Graph(_kept(relax(edges, limit), retain_fraction, seed), graph.n_items)
    below = int(retain_fraction * _PRIME)

    def pairs(find, s):
        nodes, d = find.reach(s, limit)
        later = (nodes > s) & (d > 0)
        if retain_fraction < 1:
            later &= _chance(np.int64(s), nodes, seed) < below
        return nodes[later], d[later]

    return Graph(_from_each(edges.sparkSession, arrays, pairs), graph.n_items)


def adjacency(edges: DataFrame, most: int = BROADCAST_EDGES) -> tuple | None:
    """first, to, cost and whether all costs are 1, of both directions; None for more than `most` edges. Negative
    weights raise ValueError."""
    n, low, high, last = edges.agg(F.count("*"), F.min("weight"), F.max("weight"), F.max("dst")).first()
    if low is not None and low < 0:
        raise ValueError("weights must not be negative")
    if n > most:
        return None
    local = edges.select("src", "dst", "weight").toArrow()  # at most `most` rows, as columns: 24 bytes each
    a, b, w = (local[c].to_numpy() for c in ("src", "dst", "weight"))
    src = np.r_[a, b]
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange((-1 if last is None else last) + 2))
    return first, np.r_[b, a][order], np.r_[w, w][order], low == high == 1.0


def _from_each(spark, arrays: tuple, find) -> DataFrame:
    """(src, dst, weight) of find(Search, source) for every source, which are dealt round so that the long upper rows of
    the triangle spread over tasks."""
    shared = spark.sparkContext.broadcast(arrays)

    def run(batches):
        search = Search(*shared.value)
        for b in batches:
            out = []
            for s in b["id"].tolist():
                nodes, d = find(search, s)
                out.append(pd.DataFrame({"src": np.full(len(nodes), s), "dst": nodes, "weight": d}))
            if out:
                yield pd.concat(out)

    n = len(arrays[0]) - 1
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, -(-n // 16)))
    return spark.range(n).repartition(parts, F.xxhash64("id")).mapInPandas(run, "src bigint, dst bigint, weight double")


def search_tree(graph: Graph, source: int, max_length: float | None = None) -> DataFrame:
    """(id, length, before): the nodes reached from source in order of length and id, and the node before each on a
    shortest path. The graph's edges must fit a broadcast."""
    edges = materialize(graph.edges)
    arrays = adjacency(edges)
    if arrays is None:
        raise ValueError(f"more than {BROADCAST_EDGES} edges")
    if not 0 <= source < len(arrays[0]) - 1:
        return edges.sparkSession.createDataFrame([], "id bigint, length double, before bigint")
    nodes, d, before = Search(*arrays).reach(source, float("inf") if max_length is None else max_length, predecessors=True)
    order = np.lexsort((nodes, d))
    return edges.sparkSession.createDataFrame(pd.DataFrame({"id": nodes[order], "length": d[order], "before": before[order]}), "id bigint, length double, before bigint")


def relax(edges: DataFrame, limit: float = float("inf")) -> DataFrame:
    """(src, dst, weight) of all shortest paths up to limit by joins: each round lengthens what shrank in the last
    one by one edge and keeps the least."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    step = materialize(both.where(F.col("weight") <= limit).groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    known, fresh = step, step
    while fresh.limit(1).count():
        hop = step.select(F.col("src").alias("mid"), "dst", F.col("weight").alias("w"))
        longer = fresh.withColumnRenamed("dst", "mid").join(hop, "mid").where(F.col("src") != F.col("dst"))
        longer = longer.select("src", "dst", (F.col("weight") + F.col("w")).alias("new")).where(F.col("new") <= limit)
        longer = longer.groupBy("src", "dst").agg(F.min("new").alias("new"))
        merged = materialize(known.join(longer, ["src", "dst"], "full_outer").select("src", "dst", F.least("weight", "new").alias("weight"), (F.col("weight").isNull() | (F.col("new") < F.col("weight"))).alias("changed")))
        if known is not step:
            release(known)
        known = merged
        fresh = merged.where("changed").select("src", "dst", "weight")
    return known.select("src", "dst", "weight").where("src < dst")


def graph_knn(graph: Graph, k: int, max_distance: float | None = None) -> DataFrame:
    """(src, dst, weight): neighbours by path length, weighted 1 or 2 as knn_edges(). Ties go to the smaller id.

    A complete graph's own weights serve as lengths.
    """
    edges = materialize(graph.edges)
    limit = float("inf") if max_distance is None else float(max_distance)
    full = edges.count() == graph.n_all_edges()
    arrays = None if full else adjacency(edges)
    if arrays is not None:
        top = _from_each(edges.sparkSession, arrays, lambda find, s: find.nearest(s, k, limit))
    else:
        both = Graph(edges if full else relax(edges, limit), graph.n_items).symmetric().where(F.col("weight") <= limit)
        rank = F.row_number().over(Window.partitionBy("src").orderBy("weight", "dst"))
        top = both.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def _numbers(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The ends as numbers 0..n-1, and n."""
    low, high = int(min(src.min(), dst.min())), int(max(src.max(), dst.max()))
    if high - low > 8 * len(src):
        nodes, ends = np.unique(np.r_[src, dst], return_inverse=True)
        return ends[: len(src)], ends[len(src) :], len(nodes)
    src, dst, seen = src - low, dst - low, np.zeros(high - low + 1, bool)
    seen[src] = seen[dst] = True
    number = np.cumsum(seen) - 1
    return number[src], number[dst], int(number[-1]) + 1


def _join(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the forest's edges among edges that are in order; the labels of what they join become one, in place."""
    out, at, la, lb = [], np.arange(len(a)), label[a], label[b]
    while True:
        apart = la != lb
        at, la, lb = at[apart], la[apart], lb[apart]
        if not len(at):
            return np.concatenate(out) if out else at
        first, second = np.full((2, len(label)), len(a))
        first[la[::-1]] = second[lb[::-1]] = at[::-1]  # of equal places the last value stays, which is the least
        best = np.minimum(first, second)
        c = np.flatnonzero(best < len(a))
        parent, e = np.arange(len(label)), best[c]
        parent[c] = label[a[e]] + label[b[e]] - c
        roots = c[(parent[parent[c]] == c) & (c < parent[c])]
        parent[roots] = roots
        while (parent != (up := parent[parent])).any():
            parent = up
        label[:], la, lb = parent[label], parent[la], parent[lb]
        out.append(np.unique(e))


def forest(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest, ties by ends. The lightest edges are sorted and joined first;
    heavier ones within what these join are the last of a cycle and drop out unsorted."""
    if not len(src):
        return np.zeros(0, np.int64)
    a, b, n = _numbers(src, dst)
    w = np.where(np.isnan(weight), np.inf, weight) if np.isnan(weight).any() else weight
    label, left, most, taken = np.arange(n), np.arange(len(src)), 4 * n, []
    while len(left):
        light = w[left] <= np.partition(w[left], most)[most] if len(left) > 2 * most else np.ones(len(left), bool)
        now = left[light]
        now = now[np.lexsort((dst[now], src[now], w[now]))]
        taken.append(now[_join(a[now], b[now], label)])
        if sum(map(len, taken)) == n - 1:
            break
        left, most = left[~light], 4 * most
        left = left[label[a[left]] != label[b[left]]]
    return np.concatenate(taken)


def _thinned(parts, most: int):
    """Of an iterator of arrays (src, dst, weight), what is no heaviest edge of a cycle: one forest, or, where it is
    larger than half of the `most` edges that are held, one of each stretch of so many."""
    held, n = [], 0

    def cut():
        src, dst, weight = (np.concatenate(c) for c in zip(*held))
        keep = forest(src, dst, weight)
        return src[keep], dst[keep], weight[keep]

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n > most:
            held = [cut()]
            n = len(held[0][0])
            if n > most // 2:
                yield held.pop()
                n = 0
    if held:
        yield cut()


def _thin(edges: DataFrame, most: int) -> DataFrame:
    """The edges that are left of each task's (_thinned)."""

    def run(batches):
        schema = None

        def parts():
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)

        for part in _thinned(parts(), most):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(part, schema)], schema=schema)

    return edges.mapInArrow(run, edges.schema)


def spanning_forest(graph: Graph, last_edges: int = LAST_EDGES) -> DataFrame:
    """Edges of a minimum spanning forest, ties by ends.

    Every task drops the heaviest edge of each cycle within its own edges, which is in no such forest; what is left goes
    to fewer tasks, and at last, with at most last_edges, to one. Where that does not halve the edges (very many nodes),
    joins go on: each round every component takes its least edge outwards and the components it joins become one.
    """
    from filigree.operators.components import min_labels

    edges = graph.edges.select("src", "dst", "weight").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    edges = materialize(_thin(edges, HELD_EDGES))
    n, before = edges.count(), float("inf")
    while n > last_edges and n <= before / 2:
        thinner = materialize(_thin(edges.coalesce(-(-n // last_edges)), max(last_edges, HELD_EDGES)))
        release(edges)
        edges, before, n = thinner, n, thinner.count()
    if n <= last_edges:
        return _thin(edges.coalesce(1), last_edges)
    label = materialize(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("label", F.col("node")))
    taken = None
    while True:
        a, b = label.select(F.col("node").alias("src"), F.col("label").alias("la")), label.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
        open_ = edges.join(a, "src").join(b, "dst").where("la <> lb")
        ends = open_.select(F.col("la").alias("c"), F.struct("weight", "src", "dst").alias("e")).union(open_.select("lb", F.struct("weight", "src", "dst")))
        best = materialize(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        if not best.limit(1).count():
            break
        taken = best if taken is None else taken.unionByName(best)
        joined = best.join(a, "src").join(b, "dst")
        new = min_labels(joined.select("la", "lb"), "la", "lb").withColumnRenamed("node", "old").withColumnRenamed("label", "new")
        label = materialize(label.join(new, label.label == new.old, "left").select("node", F.coalesce("new", "label").alias("label")))
    out = taken if taken is not None else edges.limit(0)
    return out.select("src", "dst", "weight").distinct()


def spanning_forest_of_points(items: DataFrame) -> DataFrame:
    """spanning_forest() of all pairs of items (id, x) by their distance, as distances.pairwise() has them: copies are not
    tied. Every distance is made, but a task keeps the forest of its pairs only, so the pairs are never a table."""

    def run(tiles_):
        def parts():
            for b in _all_in_tile(tiles_):
                src, dst, weight = (b[c].to_numpy() for c in ("src", "dst", "distance"))
                keep = forest(src, dst, weight)
                yield src[keep], dst[keep], weight[keep]

        for src, dst, weight in _thinned(parts(), HELD_EDGES):
            yield pd.DataFrame({"src": src, "dst": dst, "weight": weight})

    grid = tiles(items, 512).coalesce(4 * items.sparkSession.sparkContext.defaultParallelism)
    return spanning_forest(Graph(grid.mapInPandas(run, "src bigint, dst bigint, weight double"), items.count()))
