import tracemalloc
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree import queries
from filigree.functions import kernels as K
from filigree.operators import transform
from filigree.operators.graph import Graph
from filigree.plans import constraints as C
from filigree.plans import recipes, solver, spectral
from filigree.plans.problem import MDE, anchored, indexed_items
from filigree.sources import readers
from filigree.streaming import incremental

EDGE = "src bigint, dst bigint, weight double"


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")


def block(df):
    return np.stack([r["x"] for r in df.orderBy("id").collect()])


def five(spark):
    return spark.createDataFrame([(0, 1, 1.0), (0, 4, 2.0), (1, 2, 5.0), (2, 3, 6.0)], EDGE)


@pytest.mark.parametrize("local", [True, False])
def test_five_items(spark, local):
    m = MDE(5, 2, five(spark), K.quadratic(), C.Standardized())
    x = block(m.embed(local=local))
    assert m.value == pytest.approx(6.288406, abs=1e-5) and m.average_distortion() == pytest.approx(m.value)
    np.testing.assert_allclose(x.T @ x / 5, np.eye(2), atol=1e-8)
    assert m.solve_stats().count() == m.stats.iterations + 1 and "iterations" in str(m.stats)


def test_refused_problems(spark):
    with pytest.raises(ValueError, match="self"):
        MDE(3, 2, spark.createDataFrame([(0, 0, 1.0)], EDGE), K.quadratic())
    with pytest.raises(ValueError):
        MDE(2, 2, spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], EDGE), K.quadratic())
    m = MDE(5, 2, five(spark), K.quadratic())
    with pytest.raises(ValueError):
        m.distances()
    with pytest.raises(ValueError):
        m.embed(max_iter=-1)
    with pytest.raises(ValueError):
        m.embed(memory_size=0)


def test_quadratic_optimum_is_the_eigenvalue_sum(spark):
    rng = np.random.default_rng(2)
    n, m = 30, 3
    e = [(i, j, float(rng.uniform(0.1, 2))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3 or j == i + 1]
    p = MDE(n, m, spark.createDataFrame(e, EDGE), K.quadratic(), C.Standardized())
    p.embed(eps=1e-7, max_iter=2000)
    lap = np.zeros((n, n))
    for i, j, w in e:
        lap[[i, j], [i, j]] += w
        lap[i, j] -= w
        lap[j, i] -= w
    assert p.value == pytest.approx(n / len(e) * np.linalg.eigvalsh(lap)[1 : m + 1].sum(), rel=1e-5)


@pytest.mark.parametrize("size", [(2, 2), (10, 3), (100, 3), (1000, 2), (1000, 250)])
def test_projections(size):
    z = np.random.default_rng(0).normal(size=size)
    x = C.Standardized().project(z)
    if size[0] == size[1]:  # centred, two items span one dimension only
        np.testing.assert_allclose(x.T @ x / size[0], np.eye(size[1]), atol=1e-6)
    else:
        np.testing.assert_allclose(x.mean(axis=0), 0, atol=1e-8)
        np.testing.assert_allclose(x.T @ x / size[0], np.eye(size[1]), atol=1e-6)
    s = C.Sphere(2.0)
    y = s.project(z)
    np.testing.assert_allclose(np.linalg.norm(y, axis=1), 2)
    np.testing.assert_allclose((s.tangent(y, z) * y).sum(axis=1), 0, atol=1e-8)
    a = C.Anchored([0, 1], z[:2] + 5)
    np.testing.assert_allclose(a.project(z)[:2], z[:2] + 5)
    assert not a.tangent(z, z)[:2].any()


def test_pca_and_spectral(spark):
    x = np.random.default_rng(0).normal(size=(40, 6))
    got = block(spectral.pca(points(spark, x), 3))
    u = np.linalg.svd(x - x.mean(0), full_matrices=False)[0][:, :3] * np.sqrt(40)
    np.testing.assert_allclose(np.abs((got * u).sum(0)) / 40, 1, atol=1e-8)
    with pytest.raises(ValueError):
        spectral.pca(points(spark, x), 7)
    ring = Graph.from_edges(spark.createDataFrame([(i, (i + 1) % 50, 1.0 + i % 3) for i in range(50)], EDGE))
    dense = block(spectral.spectral(ring, 2))
    old, spectral.DENSE_ITEMS = spectral.DENSE_ITEMS, 10
    try:
        iterated = block(spectral.spectral(ring, 2))
    finally:
        spectral.DENSE_ITEMS = old
    np.testing.assert_allclose(np.linalg.svd(dense.T @ iterated / 50)[1], 1, atol=1e-6)


def test_spectral_with_edges_in_spark(spark):
    rng = np.random.default_rng(1)
    e = spark.createDataFrame([(i, j, float(rng.uniform(0.5, 2))) for i in range(40) for j in range(i + 1, 40) if j == i + 1 or rng.random() < 0.2], EDGE)
    a, b = spectral.spectral_start(e, 40, 2), spectral.spectral_start(e, 40, 2, local_edges=0)
    np.testing.assert_allclose(np.linalg.svd(a.T @ b / 40)[1], 1, atol=1e-3)


def test_spectral_stops_alike_on_both_ways(spark, monkeypatch):
    seen = []
    whole = spectral.smallest
    monkeypatch.setattr(spectral, "DENSE_ITEMS", 10)
    monkeypatch.setattr(spectral, "smallest", lambda times, *a, **k: (seen.append((a[1:], k)), whole(times, *a, **k))[1])
    ring = spark.createDataFrame([(i, (i + 1) % 50, 1.0 + i % 3) for i in range(50)], EDGE)
    a, b = spectral.spectral_start(ring, 50, 2), spectral.spectral_start(ring, 50, 2, local_edges=0)
    assert seen[0] == seen[1]
    np.testing.assert_allclose(np.linalg.svd(a.T @ b / 50)[1], 1, atol=1e-6)


def test_eigenvectors_that_have_not_converged_are_reported():
    n = 300
    degree = np.full(n, 2.0)
    ring = lambda v: 2 * v - np.roll(v, 1, axis=0) - np.roll(v, -1, axis=0)
    with pytest.warns(RuntimeWarning, match="not converged"):
        spectral.smallest(ring, degree, 2, max_iter=3)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        spectral.smallest(ring, degree, 2)


def test_coinciding_starts(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], EDGE)
    assert recipes._coincide(e, np.array([[0.0, 1], [0, 1], [2, 2]])) and not recipes._coincide(e, np.array([[0.0, 1], [0, 2], [2, 2]]))


def test_recipes(spark):
    x = np.random.default_rng(0).uniform(size=(100, 10))
    p = points(spark, x)
    lap = recipes.laplacian_embedding(p)
    lap.embed()
    e = lap.edges.toPandas()
    laplacian = np.zeros((100, 100))
    for r in e.itertuples():
        laplacian[[r.src, r.dst], [r.dst, r.src]] -= r.weight
    np.fill_diagonal(laplacian, -laplacian.sum(axis=1))
    assert lap.value == pytest.approx(100 / len(e) * np.linalg.eigvalsh(laplacian)[1:3].sum(), rel=1e-4)
    again = [sorted(map(tuple, recipes.preserve_neighbors(p).edges.collect())) for _ in range(2)]
    assert again[0] == again[1]
    d = recipes.preserve_distances(p, max_distances=1000)
    assert 900 < d.p <= 1000
    before = d.average_distortion(points(spark, C.Centered().initial(100, 2, np.random.default_rng(0))))
    d.embed(max_iter=50)
    assert d.value < before
    for init in ("quadratic", "random"):
        pins = C.Anchored([41, 7], [[-0.5, 4.0], [2.5, 0.25]])
        q = recipes.preserve_neighbors(p, 2, constraint=pins, init=init)
        np.testing.assert_allclose(q.initial[[41, 7]], pins.values)
    with pytest.raises(ValueError):
        recipes.preserve_neighbors(p, init="other")
    with pytest.raises(ValueError):
        recipes.preserve_neighbors(points(spark, [[1, 2]]))


def test_registered_preserve_distances_takes_all_pairs(spark, tmp_path, monkeypatch):
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(np.random.default_rng(0).normal(size=(700, 4)))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(MDE, "embed", lambda self: self)
    assert queries.preserve_distances(spark, str(tmp_path)).p == 700 * 699 // 2


@pytest.mark.parametrize("name", ["embed_distributed", "draw_graph", "embed_by_tables"])
def test_registered_solves_keep_the_default_stop(spark, monkeypatch, name):
    class Problem:
        def embed(self, X=None, eps=1e-5, max_iter=300, local=None):
            return max_iter

    for part in ("_items", "_hops", "_edges", "_points", "materialize"):
        monkeypatch.setattr(queries, part, lambda *a: None)
    for part in ("draw", "preserve_neighbors"):
        monkeypatch.setattr(recipes, part, lambda *a: Problem())
    monkeypatch.setattr(solver, "descend", lambda edges, points, kernel, steps=10: steps)
    assert getattr(queries, name)(spark, "") == (10 if name == "embed_by_tables" else 300)


@pytest.mark.parametrize("n", [100, 10**6])
def test_neighbours_are_exact_unless_asked_otherwise(monkeypatch, n):
    class Items:
        def count(self):
            return n

    monkeypatch.setattr(recipes.N, "knn", lambda *a: "exact")
    monkeypatch.setattr(recipes.N, "knn_approximate", lambda *a: "approximate")
    monkeypatch.setattr(recipes.N, "knn_edges", lambda near, far: near)
    assert recipes.neighbour_graph(Items(), 5) == "exact"
    assert recipes.neighbour_graph(Items(), 5, approximate=True) == recipes.neighbour_graph(Items(), 5, probes=3) == "approximate"


def test_edges_between_pinned_items_are_gone(spark):
    pinned = [2, 5, 11, 17]
    q = recipes.preserve_neighbors(points(spark, np.random.default_rng(4).normal(size=(20, 3))), 1, constraint=C.Anchored(pinned, np.arange(4.0)[:, None]))
    ends = [(r["src"], r["dst"]) for r in q.edges.collect()]
    assert ends and not any(a in pinned and b in pinned for a, b in ends) and any((a in pinned) != (b in pinned) for a, b in ends)


@pytest.mark.parametrize("n,k", [(5, 5), (1200, 5), (1500, 7), (2000, 9), (3001, 15), (10**6, 15)])
def test_default_neighbours(n, k):
    assert recipes.default_neighbours(n) == k


def test_draw_and_tables(spark):
    tree = spark.createDataFrame([((i - 1) // 2, i, 1.0) for i in range(1, 20)], EDGE)
    for standardized in (False, True):
        m = recipes.draw(Graph.from_edges(tree), standardized=standardized)
        m.embed(max_iter=50)
        assert m.p == 190 and np.isfinite(m.value)
    frame, seg = m.plot_frame(edges=True)
    assert frame.columns == ["id", "x1", "x2", "x3"] and seg.count() == 190
    with pytest.raises(ValueError):
        recipes.draw(Graph.from_edges(spark.createDataFrame([(0, 1, -1.0)], EDGE)))
    start = points(spark, np.random.default_rng(0).normal(size=(20, 2)))
    from filigree.operators.distances import average_distortion

    after = solver.descend(tree, start, K.quadratic(), 2)
    assert average_distortion(tree, after, K.quadratic()).first()[0] < average_distortion(tree, transform.center(start), K.quadratic()).first()[0]


def test_stochastic_and_snapshots(spark):
    m = MDE(5, 2, five(spark), K.quadratic(), C.Standardized())
    m.embed(batch_size=3)
    assert np.isfinite(m.value)
    m.embed(snapshot_every=2)
    assert m.snapshots().select("iter").distinct().count() >= 2


def test_stochastic_batches_beyond_the_driver(spark, monkeypatch):
    from filigree.plans import problem

    rng = np.random.default_rng(0)
    e = spark.createDataFrame([(i, j, 1.0) for i in range(40) for j in range(i + 1, 40) if j == i + 1 or rng.random() < 0.3], EDGE)
    m = MDE(40, 2, e, K.quadratic(), C.Standardized())
    whole = m.embed() and m.value
    monkeypatch.setattr(problem, "LOCAL_EDGES", 10)
    monkeypatch.setattr(MDE, "_arrays", lambda self, edges=None, f=MDE._arrays: f(self, edges) if edges is not None else pytest.fail("all edges collected"))
    m.embed(batch_size=60, max_iter=12)
    assert whole <= m.average_distortion() < 3 * whole


def test_trace_estimate():
    a = np.diag(np.arange(1.0, 31)) + 0.1
    product = lambda v: (a @ v.reshape(-1)).reshape(v.shape)
    assert solver.trace_estimate(product, (15, 2), 90) == pytest.approx(np.trace(a))
    assert abs(solver.trace_estimate(product, (15, 2), 30) - np.trace(a)) < 0.3 * np.trace(a)


def test_exact_trace_keeps_few_blocks():
    """With as many products as numbers no array of their square is made, and each number is asked for once."""
    n, asked = 1500, []
    weight = np.arange(1.0, 2 * n + 1).reshape(n, 2)
    product = lambda v: asked.append(1) or weight * v
    tracemalloc.start()
    assert solver.trace_estimate(product, (n, 2), 6 * n) == pytest.approx(weight.sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000 and len(asked) == 2 * n


def test_trace_by_colours():
    """Unlike weights on an odd ring with a chord and an item without edges: equal to the dense Hessian's trace."""
    src, dst = np.array([0, 1, 2, 3, 0, 0]), np.array([1, 2, 3, 4, 4, 2])
    colour = solver.colours(src, dst, 6)
    assert (colour[src] != colour[dst]).all() and colour.max() == 2 and colour[5] == 0
    objective = solver.LocalObjective(src, dst, np.arange(1.0, 7), K.log1p())
    for free in (C.Anchored(np.zeros(0, np.int64), np.zeros((0, 2))), C.Anchored(np.array([1]), np.ones((1, 2)))):
        product = solver.hessian_product(objective, free, np.random.default_rng(1).standard_normal((6, 2)))
        dense = np.column_stack([product(u.reshape(6, 2)).ravel() for u in np.eye(12)])
        assert solver.trace_estimate(product, (6, 2), 6, colour=colour) == pytest.approx(np.trace(dense), rel=1e-5)
        assert solver.trace_estimate(product, (6, 2), 12) == pytest.approx(np.trace(dense), rel=1e-9)


def test_weights_of_their_own_in_a_solve(spark):
    rows = [(0, 1, (1.0, 5.0)), (1, 2, (2.0, 0.5)), (0, 2, (9.0, 0.0))]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, weight struct<deviation: double, weight: double>")
    for local in (True, False):
        m = MDE(3, 2, e, K.loss_weighted_quadratic(given=True))
        m.embed(local=local)
        assert m.value == pytest.approx(0, abs=1e-8) and m.average_distortion() == pytest.approx(0, abs=1e-8)


def test_incremental(spark):
    x = np.random.default_rng(0).normal(size=(60, 3))
    p = points(spark, x)
    stored = p.where("id < 50")
    emb = recipes.preserve_neighbors(stored).embed()
    new = incremental.place(p.where("id >= 50"), stored, emb, 3)
    assert sorted(r["id"] for r in new.collect()) == list(range(50, 60))


def test_stream(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(40, 3))
    p = points(spark, x)
    p.where("id >= 30").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id bigint, x array<double>").parquet(str(tmp_path / "in"))
    q = incremental.stream(source, p.where("id < 30"), points(spark, x[:30, :2]), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_a_stream_that_grows_and_is_run_again(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(40, 3))
    p = points(spark, x)
    for k, cond in enumerate(("id >= 30 AND id < 35", "id >= 35")):
        p.where(cond).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema("id bigint, x array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for ckpt in ("a", "b"):  # the second run writes the same epochs anew
        q = incremental.stream(source, p.where("id < 30"), points(spark, x[:30, :2]), str(tmp_path / "out"), str(tmp_path / ckpt), grow=True)
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in got.collect()) == list(range(30, 40)) and got.select("epoch").distinct().count() == 2


def test_named_datasets(spark, tmp_path):
    root = tmp_path
    (root / "population_genetics").mkdir()
    for name, text in (("data", "a,b\n1,2\n3,4\n"), ("corrupted_data", "a,b\n5,6\n"), ("data_colors", "r,g,b\n0,0,1\n1,0,0\n"), ("corrupted_colors", "r,g,b\n0,1,0\n")):
        (root / "population_genetics" / f"{name}.csv").write_text(text)
    g = readers.population_genetics(spark, str(root))
    assert block(g.data).tolist() == [[1, 2], [3, 4]] and block(g.other_data["corrupted_data"]).tolist() == [[5, 6]] and g.attribute is None
    assert [tuple(r) for r in g.attributes["clean_colors"].orderBy("id").collect()] == [(0, [0, 0, 1]), (1, [1, 0, 0])]
    at = root / "scholar"
    at.mkdir()
    np.savez(at / "scholar_graph.npz", data=np.array([2.0, 2.0]), indices=np.array([1, 0]), indptr=np.array([0, 1, 2]), shape=np.array([2, 2]))
    spark.createDataFrame([("x", 0.5), ("y", 0.75)], "name string, coauthors_pct double").coalesce(1).write.parquet(str(at / "scholar_df.parquet"))
    full = readers.google_scholar(spark, str(root), full=True)
    assert full.data.n_items == 2 and [r["value"] for r in full.attribute.orderBy("id").collect()] == [0.5, 0.75]
    at = root / "counties"
    at.mkdir()
    np.save(at / "county_data.npy", np.eye(2))
    np.save(at / "democratic_fraction.npy", np.array([0.25, 0.5]))
    for name in ("acs2017_county_data", "2016_US_County_Level_Presidential_Results"):
        (at / f"{name}.csv").write_text("k\n1\n")
    c = readers.counties(spark, str(root))
    assert block(c.data).tolist() == [[1, 0], [0, 1]] and c.attribute.count() == 2 and set(c.other_data) == {"county_dataframe", "voting_dataframe"}
    for load in (readers.mnist, readers.fashion_mnist, readers.google_scholar_interests, readers.covid19_scrna_wilk, readers.google_scholar):
        with pytest.raises(FileNotFoundError):
            load(spark, str(root))


def test_readers(spark, tmp_path):
    a = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "a.npy", a)
    np.testing.assert_array_equal(block(readers.read_npy(spark, str(tmp_path / "a.npy"))), a)
    np.save(tmp_path / "l.npy", np.array(["x", "y"]))
    assert [r["value"] for r in readers.read_npy(spark, str(tmp_path / "l.npy")).orderBy("id").collect()] == ["x", "y"]
    np.savez(tmp_path / "g.npz", data=np.array([2.0, 2.0]), indices=np.array([1, 0]), indptr=np.array([0, 1, 2, 2]), shape=np.array([3, 3]))
    g = readers.read_npz_graph(spark, str(tmp_path / "g.npz"))
    assert g.n_items == 3 and [tuple(r) for r in g.edges.collect()] == [(0, 1, 2.0)]
    (tmp_path / "i.idx").write_bytes(b"\0\0\x08\x03" + b"\0\0\0\x02\0\0\0\x01\0\0\0\x02" + bytes([1, 2, 3, 4]))
    np.testing.assert_array_equal(block(readers.read_idx(spark, str(tmp_path / "i.idx"))), [[1, 2], [3, 4]])
    (tmp_path / "t.csv").write_text("id,a,b\n0,1,2.5\n1,3,4\n")
    np.testing.assert_array_equal(block(readers.read_csv_matrix(spark, str(tmp_path / "t.csv"), id_column="id")), [[1, 2.5], [3, 4]])
    np.testing.assert_array_equal(block(readers.sparse_matrix(spark.createDataFrame([(0, [1], [5.0])], "id bigint, indices array<int>, values array<double>"), 3)), [[0, 5, 0]])
    with pytest.raises(FileNotFoundError):
        readers.read_npy(spark, str(tmp_path / "none.npy"))
    with pytest.raises(ValueError):
        readers.dense_matrix(spark, np.array(["a"]))
    one = readers.Dataset(None, {"a": 1})
    assert one.attribute == 1 and readers.Dataset(None, {"a": 1, "b": 2}).attribute is None


def test_items_get_dense_numbers(spark):
    t = spark.createDataFrame([(7,), (3,), (50,), (11,)], "id bigint")
    assert [r["idx"] for r in indexed_items(t).orderBy("id").collect()] == [0, 1, 2, 3]
    a = anchored(spark.createDataFrame([(3, [1.0]), (1, [2.0])], "id bigint, x array<double>"))
    assert a.anchors.tolist() == [1, 3]
