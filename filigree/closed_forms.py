"""Queries whose result is known in closed form, so that SQL can check solvers, transforms and constructors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from filigree.functions import kernels as K
from filigree.operators import distances, knn, paths, transform
from filigree.operators.graph import Graph, above, incidence
from filigree.plans import recipes, solver
from filigree.plans import spectral as spectral_plans
from filigree.plans.constraints import Anchored, Sphere, Standardized
from filigree.plans.problem import MDE
from filigree.queries import _KNN, _edges, _flat, _hops, _items, _points, _r
from filigree.session import materialize, read

QUERIES = {}
SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _suppliers(spark, d):
    """Suppliers as items 0..n-1."""
    return read(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_acctbal").cast("double").alias("v"))


def _chain(spark, d):
    """Each supplier tied to the next."""
    ids = _suppliers(spark, d)
    n = ids.count()
    edges = materialize(ids.where(F.col("id") < n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight")))
    return edges, n


# ---- graphs


@query(
    """WITH e AS (SELECT src, dst, weight FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND NOT isnan(weight))
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(sum(weight), 4) AS weight FROM e GROUP BY ALL HAVING sum(weight) <> 0 AND abs(sum(weight)) < 'inf'::DOUBLE"""
)
def graph_without_infinities(spark, d):
    """All rows of edges that are no loops, infinite weights among them."""
    rows = read(spark, d, "edges").where("src <> dst AND NOT coalesce(isnan(weight), false)").select("src", "dst", "weight")
    return Graph.from_edges(rows).edges.select("src", "dst", _r("weight", 4).alias("weight"))


@query("SELECT true AS refused, 10 AS n_items")
def graph_self_edges_and_size(spark, d):
    """A self edge is refused, and items without a remaining edge count."""
    try:
        Graph.from_edges(spark.createDataFrame([(0, 0, 5.0), (0, 1, 1.0)], "src bigint, dst bigint, weight double"))
        refused = False
    except ValueError:
        refused = True
    g = Graph.from_edges(spark.createDataFrame([(0, 1, 1.0), (3, 9, 2.0), (9, 3, -2.0)], "src bigint, dst bigint, weight double"))
    return spark.createDataFrame([(refused, g.n_items)], "refused boolean, n_items int")


_GRID = "(SELECT a.n_nationkey AS i, b.n_nationkey AS j, CASE (a.n_nationkey * b.n_nationkey) % 4 WHEN 3 THEN 0 ELSE (a.n_nationkey * b.n_nationkey) % 4 END AS v FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)"


@query(f"SELECT CAST(i AS BIGINT) AS src, CAST(j AS BIGINT) AS dst, CAST(v AS DOUBLE) AS weight FROM {_GRID} WHERE v <> 0")
def graph_from_adjacency(spark, d):
    """A dense matrix over nations, infinite where the rule gives 3, zero on the diagonal."""
    cell = "CASE WHEN j = i THEN 0D WHEN (i * j) % 4 = 3 THEN double('inf') ELSE double((i * j) % 4) END"
    n = read(spark, d, "nation").count()
    rows = read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS i").selectExpr("i AS id", f"transform(sequence(0L, {n - 1}L), j -> {cell}) AS features")
    return Graph.from_adjacency(rows).edges


@query(f"SELECT true AS refused, count(*) AS edges FROM {_GRID} WHERE v > 1")
def graph_diagonal_and_threshold(spark, d):
    g = Graph(graph_from_adjacency(spark, d), read(spark, d, "nation").count())
    try:
        Graph.from_adjacency(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 0.0])], "id bigint, features array<double>"))
        refused = False
    except ValueError:
        refused = True
    return above(g.edges, 1.0).agg(F.lit(refused).alias("refused"), F.count("*").alias("edges"))


@query(
    """SELECT r, c, CAST(sum(v) AS BIGINT) AS value FROM (
  SELECT o_custkey % 10 AS r, o_custkey % 10 AS c, 1 AS v FROM orders WHERE o_custkey % 10 <> o_orderkey % 10 UNION ALL SELECT o_orderkey % 10, o_orderkey % 10, 1 FROM orders WHERE o_custkey % 10 <> o_orderkey % 10
  UNION ALL SELECT o_custkey % 10, o_orderkey % 10, -1 FROM orders WHERE o_custkey % 10 <> o_orderkey % 10 UNION ALL SELECT o_orderkey % 10, o_custkey % 10, -1 FROM orders WHERE o_custkey % 10 <> o_orderkey % 10) GROUP BY r, c HAVING sum(v) <> 0"""
)
def incidence_gram(spark, d):
    """The incidence matrix times its transpose is the Laplacian: a multigraph over last digits of orders."""
    e = read(spark, d, "orders").selectExpr("o_custkey % 10 AS src", "o_orderkey % 10 AS dst", "o_orderkey AS e").where("src <> dst")
    ends = e.join(incidence(e.select("src", "dst").distinct()), ["src", "dst"]).select("e", "id", "sign")
    cells = ends.groupBy("e").agg(F.collect_list(F.struct("id", "sign")).alias("a"))  # two rows an edge
    cells = cells.select(F.explode("a").alias("x"), "a").select("x", F.explode("a").alias("y"))
    out = cells.groupBy(F.col("x.id").alias("r"), F.col("y.id").alias("c")).agg(F.sum(F.col("x.sign") * F.col("y.sign")).alias("value"))
    return out.where("value <> 0")


@query("SELECT count(*) - 1 AS edges, round(max(s_acctbal) - min(s_acctbal), 2) AS total FROM (SELECT DISTINCT CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier)")
def spanning_forest_of_a_line(spark, d):
    """Points of a line, all tied to each other by their distance: the tree is the line."""
    v = _suppliers(spark, d).select("v").distinct()
    w = v.selectExpr("v", "row_number() OVER (ORDER BY xxhash64(v)) - 1 AS id")
    v = materialize(w.select(F.col("id").cast("bigint").alias("id"), F.array("v").alias("x")))
    tree = paths.spanning_forest_of_points(v)
    return tree.agg(F.count("*").alias("edges"), _r(F.sum("weight"), 2).alias("total"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey AS DOUBLE) AS length, CAST(s_suppkey - 1 AS BIGINT) AS before FROM supplier WHERE s_suppkey > 0")
def search_tree_of_a_chain(spark, d):
    edges, n = _chain(spark, d)
    return paths.search_tree(Graph(edges, n), 0)


# ---- transforms of two coordinates


_TWO = f"""WITH {_KNN}, mean AS (SELECT avg(x1) AS m1, avg(x2) AS m2, count(*) AS n FROM p),
z AS (SELECT id, x1 - m1 AS a, x2 - m2 AS b FROM p, mean), s AS (SELECT avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb FROM z),
h AS (SELECT *, sqrt(aa * bb - ab * ab) AS s, sqrt(aa + bb + 2 * sqrt(aa * bb - ab * ab)) AS t FROM s)
"""


@query(_TWO + "SELECT id, round((a * (bb + s) - b * ab) / (s * t), 6) AS x1, round((b * (aa + s) - a * ab) / (s * t), 6) AS x2 FROM z, h")
def standardize_plane(spark, d):
    """The inverse root of a 2 x 2 matrix in closed form."""
    return _flat(transform.standardize(_points(spark, d)), 2)


@query(_TWO + "SELECT true AS standardized, round(sqrt(2.0 * n * 2 / (n - 1)), 6) AS rms FROM mean")
def standardized_distances(spark, d):
    """A standardized embedding is told from others, and its root mean square distance is the natural length."""
    p = _points(spark, d)
    x = materialize(transform.standardize(p))
    yes = transform.is_standardized(x) and not transform.is_standardized(p)
    far = distances.pairwise(spark, x)
    return far.agg(F.lit(yes).alias("standardized"), _r(F.sqrt(F.avg(F.col("distance") * F.col("distance")))).alias("rms"))


@query(
    _TWO
    + """, w AS (SELECT 0.5 * atan2(2 * ab, aa - bb) AS o FROM s), v AS (SELECT CASE WHEN abs(cos(o)) >= abs(sin(o)) THEN sign(cos(o)) ELSE sign(sin(o)) END AS f, o FROM w),
c AS (SELECT id, f * (a * cos(o) + b * sin(o)) AS c FROM z, v) SELECT id, round(c / (SELECT sqrt(avg(c * c)) FROM c), 6) AS x1 FROM c"""
)
def pca_plane(spark, d):
    """The first component of two features is an angle; the coordinate has mean square 1."""
    return _flat(spectral_plans.pca(_points(spark, d), 1), 1)


@query(f"WITH {_KNN} SELECT i AS a, j AS b, CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE) AS value FROM range(0, 3) s(i), range(0, 3) t(j) WHERE i <= j")
def pca_gram(spark, d):
    g = transform.gram(spectral_plans.pca(_items(spark, d), 3))
    return g.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), _r("value").alias("value"))


@query(
    _TWO
    + """, o AS (SELECT radians(40) AS o), q AS (SELECT z.id, z.a, z.b, z.a * cos(o) + z.b * sin(o) AS c, z.b * cos(o) - z.a * sin(o) AS d FROM z, o),
k AS (SELECT sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb, sqrt(sum(c * c)) AS nc, sqrt(sum(d * d)) AS nd, sum(a * c) AS ac, sum(a * d) AS ad, sum(b * c) AS bc, sum(b * d) AS bd FROM q),
m AS (SELECT ac / (na * nc) AS p, ad / (na * nd) AS q, bc / (nb * nc) AS r, bd / (nb * nd) AS t, nc, nd FROM k),
turn AS (SELECT CASE WHEN p * t - q * r > 0 THEN (p + t) / sqrt((p + t) ** 2 + (q - r) ** 2) ELSE (p - t) / sqrt((p - t) ** 2 + (q + r) ** 2) END AS u,
    CASE WHEN p * t - q * r > 0 THEN (r - q) / sqrt((p + t) ** 2 + (q - r) ** 2) ELSE (q + r) / sqrt((p - t) ** 2 + (q + r) ** 2) END AS v, CASE WHEN p * t - q * r > 0 THEN 1 ELSE -1 END AS f, nc, nd FROM m),
y AS (SELECT id, c / nc AS c, d / nd AS d FROM q, turn)
SELECT id, round((u * c - CASE WHEN f > 0 THEN v * d ELSE -v * d END) * nc + m1 * cos(o) + m2 * sin(o), 6) AS x1,
  round((CASE WHEN f > 0 THEN v * c + u * d ELSE v * c - u * d END) * nd + m2 * cos(o) - m1 * sin(o), 6) AS x2 FROM y, turn, mean, o"""
)
def align_plane(spark, d):
    """The nearest orthogonal matrix to a 2 x 2 one in closed form: points turned by 40 degrees are aligned back."""
    return _flat(transform.align(transform.rotate(_points(spark, d), 40), _points(spark, d)), 2)


# ---- solvers


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, round(abs(sqrt(2) * cos(pi() * (s_suppkey + 0.5) / (SELECT count(*) FROM supplier))), 5) AS x1 FROM supplier")
def spectral_chain(spark, d):
    """The second eigenvector of a chain is a cosine."""
    edges, n = _chain(spark, d)
    return spectral_plans.spectral(Graph(edges, n), 1).select("id", _r(F.abs(F.element_at("x", 1)), 5).alias("x1"))


@query("SELECT 6.2884::DOUBLE AS value, 5 AS items, true AS standardized")  # fixed value: the optimum of the documented five-item problem
def embed_five_items(spark, d):
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 4, 2.0), (1, 2, 5.0), (2, 3, 6.0)], "src bigint, dst bigint, weight double")
    problem = MDE(5, 2, edges, K.quadratic(), Standardized())
    x = problem.embed()
    return spark.createDataFrame([(round(problem.average_distortion(), 4), x.count(), transform.is_standardized(x))], "value double, items bigint, standardized boolean")


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, round(s_suppkey::DOUBLE / ((SELECT count(*) FROM supplier) - 1), 3) AS x1 FROM supplier")
def embed_anchored_chain(spark, d):
    """A chain with its ends pinned to 0 and 1 under quadratic pull lies evenly between them."""
    edges, n = _chain(spark, d)
    problem = MDE(n, 1, edges, K.quadratic(), Anchored(np.array([0, n - 1]), np.array([[0.0], [1.0]])))
    return problem.embed(eps=1e-9, max_iter=3000).select("id", _r(F.element_at("x", 1), 3).alias("x1"))


@query("SELECT 3 AS items, 3.0::DOUBLE AS mean_square")
def embed_sphere_triangle(spark, d):
    """Three points on the unit circle that push each other end 120 degrees apart: squared distances of 3."""
    edges = spark.createDataFrame([(0, 1, -1.0), (0, 2, -1.0), (1, 2, -1.0)], "src bigint, dst bigint, weight double")
    problem = MDE(3, 2, edges, K.quadratic(), Sphere(1.0))
    problem.embed(eps=1e-9)
    return problem.distances().agg(F.lit(3).alias("items"), _r(F.avg(F.col("distance") * F.col("distance")), 4).alias("mean_square"))


@query("SELECT true AS self_edges, true AS too_many, true AS no_embedding, true AS bad_memory")
def problem_guards(spark, d):
    frame = lambda rows: spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    ok = MDE(3, 2, frame([(0, 1, 1.0)]), K.quadratic())

    def refused(f) -> bool:
        try:
            f()
        except ValueError:
            return True
        return False

    return spark.createDataFrame(
        [(refused(lambda: MDE(3, 2, frame([(1, 1, 1.0)]), K.quadratic())), refused(lambda: MDE(2, 2, frame([(0, 1, 1.0), (1, 0, 1.0)]), K.quadratic())), refused(lambda: ok.average_distortion()), refused(lambda: ok.embed(memory_size=0)))],
        "self_edges boolean, too_many boolean, no_embedding boolean, bad_memory boolean",
    )


def _summary(spark, problem, x):
    """One row: items, edges, whether the mean is zero and the last residual small or the iterations used up."""
    mean = transform.moments(x)[1]
    done = problem.residual_norm <= 1e-5 or problem.stats.iterations == 300
    fell = problem.stats.average_distortions[-1] <= problem.stats.average_distortions[0]
    return spark.createDataFrame([(x.count(), problem.p, bool(np.allclose(mean, 0, atol=1e-6)), bool(done and fell))], "items bigint, edges bigint, centered boolean, solved boolean")


_AUTO = "e2 AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM it a JOIN it b ON a.id <> b.id) WHERE r <= (SELECT greatest(least(15, (count(*) - 1) // 200), 5) FROM it))"


@query(f"WITH {_KNN}, {_AUTO} SELECT count(*) AS edges, (SELECT count(*) FROM it) AS items, true AS centered, true AS solved FROM e2")
def laplacian_embedding_summary(spark, d):
    problem = recipes.laplacian_embedding(_items(spark, d))
    return _summary(spark, problem, problem.embed())


@query(f"WITH {_KNN}, {_AUTO} SELECT (SELECT count(*) FROM e2) AS pulling, true AS pushing, (SELECT count(*) FROM it) AS items, true AS centered, true AS solved")
def preserve_neighbors_summary(spark, d):
    """Neighbours pull; about as many other pairs push."""
    problem = recipes.preserve_neighbors(_items(spark, d))
    row = _summary(spark, problem, problem.embed())
    pull = problem.edges.where("weight > 0").count()
    return row.select(F.lit(pull).cast("bigint").alias("pulling"), F.col("edges").between(pull, 2 * pull).alias("pushing"), "items", "centered", "solved")


@query(f"WITH {_KNN} SELECT (SELECT count(*) FROM it a JOIN it b ON a.id < b.id WHERE list_distance(a.x, b.x) > 0) AS edges, (SELECT count(*) FROM it) AS items, true AS centered, true AS solved")
def preserve_distances_summary(spark, d):
    problem = recipes.preserve_distances(_items(spark, d))
    return _summary(spark, problem, problem.embed())


@query(
    f"""WITH RECURSIVE {_KNN}, both_ AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), reach AS (SELECT src, dst FROM both_ UNION SELECT r.src, b.dst FROM reach r JOIN both_ b ON r.dst = b.src)
SELECT (SELECT count(*) FROM reach WHERE src < dst) AS edges, (SELECT count(*) FROM it) AS items, true AS centered, true AS solved"""
)
def draw_graph_summary(spark, d):
    problem = recipes.draw(_hops(spark, d))
    return _summary(spark, problem, problem.embed())


@query(f"WITH {_KNN} SELECT count(*) * 10 AS pairs, true AS recalled FROM it")
def ann_recall(spark, d):
    """Approximate neighbours of all items hold at least nine tenths of the true ones."""
    items = materialize(_items(spark, d))
    near = materialize(knn.knn_approximate(items, 10, 44).select("src", "dst"))
    both = near.join(knn.knn(items, 10).select("src", "dst"), ["src", "dst"])
    n = near.count()
    return both.agg(F.lit(n).cast("bigint").alias("pairs"), (F.count("*") >= 0.9 * n).alias("recalled"))


# ---- gradients


@query(f"WITH {_KNN} SELECT id, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2 FROM it WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)")
def gradient_of_coincident_points(spark, d):
    """Where all points coincide the gradient is zero, not undefined."""
    same = _items(spark, d).select("id", F.array(F.lit(1.0), F.lit(1.0)).alias("x"))
    g = distances.gradient(_edges(spark, d), same, K.log1p())
    return g.select("id", _r(F.element_at("gradient", 1)).alias("g1"), _r(F.element_at("gradient", 2)).alias("g2"))


@query(
    f"""WITH {_KNN}, s AS (SELECT src, dst, d1, d2 FROM g WHERE src % 3 > 0 AND dst % 3 > 0)
SELECT id, round(sum(a) * 2 / (SELECT count(*) FROM s), 6) AS g1, round(sum(b) * 2 / (SELECT count(*) FROM s), 6) AS g2
FROM (SELECT src AS id, d1 AS a, d2 AS b FROM s UNION ALL SELECT dst, -d1, -d2 FROM s) GROUP BY id"""
)
def gradient_without_some_points(spark, d):
    """Edges with an end that has no point count neither in the mean nor in the gradient."""
    e = _edges(spark, d).withColumn("weight", F.lit(1.0))
    g = distances.gradient(e, _points(spark, d).where("id % 3 > 0"), K.quadratic())
    return g.select("id", _r(F.element_at("gradient", 1)).alias("g1"), _r(F.element_at("gradient", 2)).alias("g2"))


_PAIR = "w AS (SELECT src, dst, d, u, 0.5 + (src % 5) / 4.0 AS k FROM g)"


def _given(spark, d, kernel):
    """Losses with a weight of its own for each pair, beside the deviation."""
    e = _edges(spark, d).select("src", "dst", F.struct((F.lit(0.2) + (F.col("src") + F.col("dst")) % 7 * 0.2).alias("deviation"), (F.lit(0.5) + F.col("src") % 5 / 4.0).alias("weight")).alias("weight"))
    return distances.distortions(e, _points(spark, d), kernel).select("src", "dst", _r("distortion").alias("distortion"))


@query(f"WITH {_KNN}, {_PAIR} SELECT src, dst, round(k * pow(d - u, 2), 6) AS distortion FROM w")
def loss_weighted_quadratic_given(spark, d):
    return _given(spark, d, K.loss_weighted_quadratic(given=True))


@query(f"WITH {_KNN}, {_PAIR} SELECT src, dst, round(k * pow(abs(d - u), 1.5), 6) AS distortion FROM w")
def loss_weighted_power_given(spark, d):
    return _given(spark, d, K.loss_weighted_power(1.5, given=True))


@query(f"WITH {_KNN} SELECT src, dst, round(w * ln(1 + pow(d, 1.5)), 6) AS value, round(w * d * abs(d - 1), 6) AS own FROM g")
def kernels_in_sql(spark, d):
    """A kernel, and a user function of distance and weight, called from SQL."""
    K.register(spark, "filigree_log1p", K.log1p())
    K.register(spark, "filigree_own", K.custom(lambda x, w: w * x * np.abs(x - 1)))
    e = distances.with_distance(_edges(spark, d), _points(spark, d)).withColumn("w", ((F.col("src") * 7 + F.col("dst") * 3) % 11 - 5) / 2.0)
    return e.selectExpr("src", "dst", "round(filigree_log1p(distance, w), 6) + 0.0D AS value", "round(filigree_own(distance, w), 6) + 0.0D AS own")


@query("SELECT round(2.0 * 2 * 2 * (count(*) - 1) / (count(*) - 1), 4)::DOUBLE AS trace FROM supplier")
def curvature_trace(spark, d):
    """The trace of the second derivative of a chain's mean squared length: 2 / p times that of its Laplacian, for each
    of two coordinates. With as many products as numbers the estimate is exact; items that no edge ties share theirs."""
    edges, n = _chain(spark, d)
    free = Anchored(np.zeros(0, np.int64), np.zeros((0, 2)))
    objective = MDE(n, 2, edges, K.quadratic()).objective()
    product = solver.hessian_product(objective, free, np.random.default_rng(0).standard_normal((n, 2)))
    apart = solver.colours(objective.src, objective.dst, n) if isinstance(objective, solver.LocalObjective) else None
    return spark.createDataFrame([(round(solver.trace_estimate(product, (n, 2), 6 * n, colour=apart), 4),)], "trace double")


@query("SELECT count(*) AS items, true AS refused, true AS even FROM supplier")
def embed_sampled_pairs(spark, d):
    """A problem without edges, whose function samples the pairs of a chain: the ends are pinned, and the others come to
    lie evenly between them."""
    n = _suppliers(spark, d).count()

    def sampler(size, rng):
        a = rng.choice(n - 1, min(size, n - 1), replace=False)
        return a, a + 1, np.ones(len(a))

    pins = Anchored(np.array([0, n - 1]), np.array([[0.0], [1.0]]))
    try:
        MDE(n, 1, None, K.quadratic(), pins)
        refused = False
    except ValueError:
        refused = True
    start = np.linspace(0, 1, n)[:, None] + 0.01 * np.random.default_rng(0).standard_normal((n, 1))
    problem = MDE(n, 1, None, solver.Stochastic(K.quadratic(), sampler, 4 * n), pins, start)
    x = problem.embed(max_iter=40, eps=1e-9)
    off = np.abs(problem.block[:, 0] - np.linspace(0, 1, n)).max()
    return x.agg(F.count("*").alias("items"), F.lit(refused).alias("refused"), F.lit(bool(off < 0.02)).alias("even"))
