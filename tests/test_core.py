import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.operators import diagnostics, distances, hot_keys, knn, pairs, paths, transform
from filigree.operators.components import min_labels
from filigree.operators.graph import Graph, radius
from filigree.functions import kernels as K

EDGE = "src bigint, dst bigint, weight double"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], EDGE)


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ring(spark):
    g = Graph.from_edges(edges(spark, [(4, 2, 7), (2, 0, 2.5), (0, 1, 1.5), (1, 3, 6), (3, 4, 0.5)]))
    assert got(g.edges, "src", "dst", "weight") == [(0, 1, 1.5), (0, 2, 2.5), (1, 3, 6), (2, 4, 7), (3, 4, 0.5)]
    assert got(g.neighbours(4), "neighbour", "distance") == [(2, 7), (3, 0.5)]
    assert (g.n_items, g.n_edges(), g.n_all_edges(), g.weight(2, 4), g.weight(0, 4)) == (5, 5, 10, 7.0, 0.0)


def test_repeated_edges_are_summed_and_zeros_dropped(spark):
    g = Graph.from_edges(edges(spark, [(1, 6, 2.5), (6, 1, 0.25), (2, 4, 3), (4, 2, -3), (0, 1, 0), (5, 5, 0), (7, 3, float("inf"))]))
    assert got(g.edges, "src", "dst", "weight") == [(1, 6, 2.75)] and g.n_items == 8
    assert Graph.from_edges(edges(spark, [])).n_items == 0 and Graph.from_edges(edges(spark, [(0, 0, 0)])).n_items == 1
    with pytest.raises(ValueError, match="self"):
        Graph.from_edges(edges(spark, [(0, 1, 1), (4, 4, 2)]))


def test_adjacency(spark):
    g = Graph.from_adjacency(spark.createDataFrame([(0, [0.0, 0.5, 4.0, 0.0]), (1, [0.5, 0.0, float("inf"), 6.0]), (2, [4.0, float("inf"), 0.0, -2.0]), (3, [0.0, 6.0, -2.0, 0.0])], "id bigint, features array<double>"))
    assert got(g.edges, "src", "dst", "weight") == [(0, 1, 0.5), (0, 2, 4), (1, 3, 6), (2, 3, -2)]
    with pytest.raises(ValueError):
        Graph.from_adjacency(spark.createDataFrame([(0, [1.0])], "id bigint, features array<double>"))


def test_paths_weighted_and_hops(spark):
    g = Graph.from_edges(edges(spark, [(0, 1, 2), (1, 2, 0.5), (2, 3, 4), (3, 0, 5)]))
    for p in (paths.shortest_paths(g).edges, paths.relax(g.edges)):
        assert got(p, "src", "dst", "weight") == [(0, 1, 2), (0, 2, 2.5), (0, 3, 5), (1, 2, 0.5), (1, 3, 4.5), (2, 3, 4)]
    n = 60
    ring = Graph.from_edges(edges(spark, [(i, (i + 1) % n, 2) for i in range(n)]))
    for p in (paths.shortest_paths(ring, 4).edges, paths.shortest_paths(ring, 4, broadcast_edges=0).edges):
        assert p.count() == 2 * n and {r["weight"] for r in p.collect()} == {2.0, 4.0}
    assert 0 < paths.shortest_paths(ring, 40, 0.3).edges.count() < paths.shortest_paths(ring, 40).edges.count()
    assert paths.shortest_paths(Graph.empty(spark, 3)).edges.count() == 0
    with pytest.raises(ValueError):
        paths.shortest_paths(Graph.from_edges(edges(spark, [(0, 1, -1)])))


def test_graph_knn_and_forest(spark):
    g = Graph.from_edges(edges(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 5), (0, 3, 9)]))
    assert got(paths.graph_knn(g, 1), "src", "dst", "weight") == [(0, 1, 2), (1, 2, 1), (2, 3, 1)]
    assert got(paths.spanning_forest(g), "src", "dst") == [(0, 1), (1, 2), (2, 3)]


def kruskal(rows):
    root, out = {}, []

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, w))
    return sorted(out)


@pytest.mark.parametrize("held, last", [(1 << 20, 1 << 20), (64, 400), (64, 1)])
def test_forest_with_ties(spark, monkeypatch, held, last):
    """The edges that Kruskal takes, ties by ends, in one task, after several rounds of thinning, and by joins."""
    monkeypatch.setattr(paths, "HELD_EDGES", held)
    rng = np.random.default_rng(0)
    pairs_ = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (900, 2)) if a != b and (a < 40) == (b < 40)}
    rows = [(a * 1_000_003, b * 1_000_003, float(rng.integers(1, 6))) for a, b in sorted(pairs_)]
    assert got(paths.spanning_forest(Graph(edges(spark, rows).repartition(7), 60), last), "src", "dst", "weight") == kruskal(rows)
    assert paths.spanning_forest(Graph.empty(spark, 3), last).count() == 0


def test_forest_of_points_makes_no_table_of_pairs(spark, monkeypatch):
    """Clusters of points and copies over several blocks: the tree is Kruskal's over all pairs, and no table on the way
    has more rows than the forests of its tasks."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 2)) + 50 * rng.integers(0, 3, (700, 1))
    x[600:] = x[:100]
    items = points(spark, x).repartition(3)
    sizes, write = [], paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda df: sizes.append((t := write(df)).count()) or t)
    want = kruskal([tuple(r) for r in distances.pairwise(spark, items).collect()])
    tree = got(paths.spanning_forest_of_points(items), "src", "dst", "weight")
    assert [(a, b) for a, b, _ in tree] == [(a, b) for a, b, _ in want] and len(tree) == 699
    assert sizes and max(sizes) <= 3 * 699


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_decode_is_row_major(spark, n):
    assert got(pairs.all_pairs(spark, n), "src", "dst") == list(itertools.combinations(range(n), 2))


def test_decode_of_very_many_items(spark):
    n = 1_500_000_000
    ids = [0, 1, n - 2, n - 1, pairs.n_pairs(n) // 3, pairs.n_pairs(n) - 1]
    with pytest.raises(ValueError):
        pairs.decode(F.col("id"), 2 * n)
    u, v = pairs.decode(F.col("id"), n)
    for e, a, b in spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", u, v).collect():
        assert 0 <= a < b < n and a * (2 * n - 1 - a) // 2 + b - a - 1 == e


def test_samples(spark):
    n, total = 30, pairs.n_pairs(30)
    ex = edges(spark, [(a, b, 1) for a, b in itertools.combinations(range(9), 2)])
    for count, exact in ((50, True), (300, True), (total - 36, True), (0, True)):
        s = got(pairs.sample_edges(spark, n, count, ex, exact=exact), "src", "dst")
        assert len(s) == len(set(s)) == count and not any(b < 9 for _, b in s)
    assert pairs.sample_edges(spark, n, 50, ex).count() <= 50
    with pytest.raises(ValueError):
        pairs.sample_edges(spark, n, total - 35, ex)
    assert got(pairs.complement(spark, 4, edges(spark, [(1, 0, 1), (2, 3, 1)])), "src", "dst") == [(0, 2), (0, 3), (1, 2), (1, 3)]
    assert pairs.dissimilar_edges(spark, n, ex).count() == 36


def test_anchored_edges_go(spark):
    e = edges(spark, [(0, 1, 1), (0, 2, 1), (1, 2, 1)])
    a = spark.createDataFrame([(0,), (1,), (1,), (None,)], "id bigint")
    assert got(pairs.without_anchored(e, a), "src", "dst") == [(0, 2), (1, 2)]


def test_knn_golden_and_brute(spark):
    e = knn.knn_edges(knn.knn(points(spark, [[5], [0], [2], [2.5], [9]]), 1))
    assert got(e, "src", "dst", "weight") == [(0, 3, 1), (0, 4, 1), (1, 2, 1), (2, 3, 2)]
    x = np.random.default_rng(1).normal(size=(300, 5))
    x[10] = x[11] = x[12]
    p = points(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    expected = sorted((i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), d[i]))[:4])
    assert got(knn.knn(p, 4), "src", "dst") == expected
    near = got(knn.knn_approximate(p, 4, 16), "src", "dst")
    assert len(set(near) & set(expected)) >= 0.9 * len(expected)
    assert got(knn.knn_approximate(p, 4, 5, probes=5), "src", "dst") == expected
    none = spark.createDataFrame([(1, None), (None, [1.0])], "id bigint, x array<double>")
    assert knn.knn(none, 2).count() == 0 and knn.knn_approximate(none, 2, 4).count() == 0


def test_pairwise(spark):
    x = np.random.default_rng(0).normal(size=(40, 2))
    x[5] = x[6]
    full = got(distances.pairwise(spark, points(spark, x)), "src", "dst", "distance")
    assert len(full) == pairs.n_pairs(40) - 1
    for a, b, d in full:
        assert abs(d - np.linalg.norm(x[a] - x[b])) < 1e-9
    assert distances.pairwise(spark, points(spark, x), 50 / pairs.n_pairs(40)).count() in (49, 50)
    with pytest.raises(ValueError):
        distances.pairwise(spark, points(spark, x), 0)


def test_average_distortion_and_gradient(spark):
    rng = np.random.default_rng(8)
    x, pairs_ = rng.normal(size=(6, 3)), [(0, 1), (0, 4), (1, 5), (2, 3), (2, 5)]
    w = rng.uniform(0.5, 2, len(pairs_))
    e = edges(spark, [(a, b, v) for (a, b), v in zip(pairs_, w)])
    d2 = np.array([((x[a] - x[b]) ** 2).sum() for a, b in pairs_])
    assert distances.average_distortion(e, points(spark, x), K.quadratic()).first()[0] == pytest.approx((w * d2).mean())
    g = {r["id"]: np.array(r["gradient"]) for r in distances.gradient(e, points(spark, x), K.quadratic()).collect()}
    want = np.zeros_like(x)
    for (a, b), v in zip(pairs_, w):
        want[a] += 2 * v * (x[a] - x[b]) / len(pairs_)
        want[b] -= 2 * v * (x[a] - x[b]) / len(pairs_)
    np.testing.assert_allclose(np.stack([g[i] for i in range(6)]), want)
    part = distances.gradient(e, points(spark, x[:3]), K.quadratic()).collect()  # only (0, 1) has both ends
    np.testing.assert_allclose(next(r["gradient"] for r in part if r["id"] == 0), 2 * w[0] * (x[0] - x[1]))
    same = distances.gradient(edges(spark, [(0, 1, 1)]), points(spark, [[1, 1], [1, 1]]), K.log1p()).collect()
    assert all(v == 0 for r in same for v in r["gradient"])


def test_transforms(spark):
    x = np.random.default_rng(3).normal(size=(50, 3)) * [1, 2, 5] + 4
    p = points(spark, x)
    assert transform.is_standardized(transform.standardize(p)) and not transform.is_standardized(p)
    back = np.stack([r["x"] for r in transform.align(transform.rotate(transform.standardize(p), (10, 20, 30)), transform.standardize(p)).orderBy("id").collect()])
    np.testing.assert_allclose(back, np.stack([r["x"] for r in transform.standardize(p).orderBy("id").collect()]), atol=1e-9)
    turned = transform.rotate(points(spark, [[1, 0]]), 90).first()["x"]
    np.testing.assert_allclose(turned, [0, -1], atol=1e-12)
    with pytest.raises(ValueError):
        transform.rotate(p, 30)
    with pytest.raises(ValueError):
        transform.standardize(points(spark, [[1, 1], [2, 2], [3, 3]]))
    pinned = transform.pin(p, spark.createDataFrame([(2, [9.0, 9.0, 9.0])], "id bigint, x array<double>"))
    assert pinned.where("id = 2").first()["x"] == [9.0, 9.0, 9.0] and pinned.count() == 50


def test_cdf_counts_ties_and_hot_values(spark):
    rows = [(i, i + 1, float(min(i, 500) % 7 if i < 500 else 3)) for i in range(2000)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, distortion double")
    c = got(diagnostics.cdf(e), "value", "share")
    assert [v for v, _ in c] == sorted(r[2] for r in rows)
    np.testing.assert_allclose(sorted(s for _, s in c), np.arange(1, 2001) / 2000)
    assert diagnostics.cdf(e, max_points=100).count() <= 102
    assert diagnostics.cdf(e.limit(0)).count() == 0
    assert [r["distortion"] for r in diagnostics.extreme_pairs(e, 3).collect()] == [6.0] * 3


def test_labels_radius_and_codes(spark):
    assert radius(edges(spark, [(0, 1, w) for w in (1, 2, 3, 4)])).first()[0] == pytest.approx(3 * 3.25)
    t = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    assert sorted((r["v"] or "", r["code"]) for r in diagnostics.label_codes(t, "v").collect()) == [("", None), ("a", 0), ("b", 1), ("b", 1)]


def test_min_labels(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 620)] + [(7, 7), (1, None), (700, 701), (701, 700)]
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in links:
        if b is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    want = sorted((v, root(v)) for v in up)
    assert got(min_labels(spark.createDataFrame(links, "a bigint, b bigint")), "node", "label") == want
    assert min_labels(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


SCHEMA = "eid bigint, src bigint, dst bigint, weight double, recorded_at timestamp, loaded_at timestamp"


def test_hot_keys_standing_and_neighbours(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, k + 1) for k in range(3)]
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0, 1, 1.0, t[0], t[0]), (1, 0, 2, 1.0, t[0], t[1]), (1, 0, 2, 1.0, t[0], t[1]), (2, 2, 0, 1.0, t[0], None), (3, 3, 3, 1.0, t[0], t[0]), (4, 0, None, 1.0, t[0], t[0]), (5, 0, 4, nan, t[0], t[0]), (6, 0, 5, inf, t[0], t[0]), (7, 0, 6, 0.0, t[0], t[0]), (8, 0, 7, None, t[0], t[0]), (9, 7, 0, -2.0, t[0], t[0]), (None, 0, 8, 1.0, t[0], t[0])]
    e = spark.createDataFrame(rows, SCHEMA)
    assert got(hot_keys.neighbour_counts(hot_keys.sound_edges(e)), "node", "neighbours") == [(0, 2), (2, 1), (7, 1)]
    assert hot_keys.neighbour_counts(hot_keys.sound_edges(e.limit(0))).count() == 0


def test_join_totals_equal_the_join(spark):
    rng = np.random.default_rng(5)
    left = spark.createDataFrame([(int(k) if k else None, float(v), 1) for k, v in zip(rng.integers(0, 5, 200), rng.normal(size=200))], "k bigint, v double, by int")
    right = spark.createDataFrame([(int(k) if k else None, float(v) if v > -1 else None, int(b)) for k, v, b in zip(rng.integers(0, 6, 150), rng.normal(size=150), rng.integers(0, 3, 150))], "k bigint, v double, by int")
    want = left.withColumnRenamed("v", "a").drop("by").join(right, "k").groupBy("by").agg(F.count("*").alias("pairs"), F.sum("a").alias("left_sum"), F.sum("v").alias("right_sum"))
    a = {r["by"]: r for r in hot_keys.join_totals(left, right, "k", "v", "v", ["by"]).collect()}
    for r in want.collect():
        assert a[r["by"]]["pairs"] == r["pairs"]
        assert a[r["by"]]["left_sum"] == pytest.approx(r["left_sum"]) and a[r["by"]]["right_sum"] == pytest.approx(r["right_sum"])
    assert len(a) == want.count()
    assert hot_keys.join_totals(left.limit(0), right, "k").count() == 0


def test_searches(spark):
    rng = np.random.default_rng(2)
    n = 30
    rows = [(int(a), int(b), float(v)) for a, b, v in zip(rng.integers(0, n, 70), rng.integers(0, n, 70), rng.integers(1, 5, 70)) if a != b]
    g = Graph.from_edges(edges(spark, rows), n)
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for r in g.edges.collect():
        d[r["src"], r["dst"]] = d[r["dst"], r["src"]] = r["weight"]
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    tree = {r["id"]: (r["length"], r["before"]) for r in paths.search_tree(g, 3).collect()}
    assert {v: x for v, (x, _) in tree.items()} == {v: d[3, v] for v in range(n) if v != 3 and np.isfinite(d[3, v])}
    assert all(d[3, b] + g.weight(v, b) == x for v, (x, b) in list(tree.items())[:5])
    want = {}
    for s in range(n):
        for v in [v for v in np.lexsort((np.arange(n), d[s])) if v != s and d[s, v] <= 6][:3]:
            want[min(s, v), max(s, v)] = want.get((min(s, v), max(s, v)), 0) + 1
    assert got(paths.graph_knn(g, 3, 6.0), "src", "dst", "weight") == sorted((int(a), int(b), float(w)) for (a, b), w in want.items())
    half = paths.shortest_paths(g, retain_fraction=0.5)
    assert got(half.edges, "src", "dst") == got(paths.shortest_paths(g, retain_fraction=0.5, broadcast_edges=0).edges, "src", "dst")
    assert paths.search_tree(g, 99).count() == 0


def test_first_rows_and_numbers(spark):
    t = spark.createDataFrame([(int(k), int(i)) for i, k in enumerate(np.random.default_rng(0).integers(0, 10_000, 500))], "k bigint, i bigint")
    want = sorted((r["k"], r["i"]) for r in t.collect())
    for count in (1, 137, 500, 900):
        assert got(pairs.first_rows(t, "k", count, 10_000, ["i"]), "k", "i") == want[:count]
    assert [r["idx"] for r in pairs.numbered(t, "i").orderBy("i").collect()] == list(range(500))
    assert pairs.numbered(t.limit(0), "i").count() == 0
