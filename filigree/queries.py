"""Queries of the core operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigree.functions import kernels as K
from filigree.operators import diagnostics, distances, hot_keys, knn, pairs, paths, transform
from filigree.operators.graph import Graph, radius
from filigree.plans import recipes, solver
from filigree.plans import spectral as spectral_plans
from filigree.session import materialize, read
from filigree.streaming import incremental

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SOUND = """
WITH sound AS (SELECT src, dst, weight FROM (
    SELECT src, dst, weight, row_number() OVER (PARTITION BY eid ORDER BY loaded_at DESC NULLS LAST, src DESC, dst DESC) AS rn FROM edges WHERE eid IS NOT NULL)
  WHERE rn = 1 AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND weight IS NOT NULL AND isfinite(weight) AND weight <> 0),
neighbours AS (SELECT node, count(DISTINCT other) AS neighbours FROM (
    SELECT src AS node, dst AS other FROM sound UNION ALL SELECT dst, src FROM sound) GROUP BY node)
"""


@query(_SOUND + "SELECT node FROM neighbours WHERE neighbours >= 40")
def p4_found(spark, d):
    return hot_keys.neighbour_counts(hot_keys.sound_edges(read(spark, d, "edges"))).where("neighbours >= 40").select("node")


@query(_SOUND + "SELECT node, neighbours FROM neighbours")
def p4_neighbours(spark, d):
    return hot_keys.neighbour_counts(hot_keys.sound_edges(read(spark, d, "edges")))


@query(
    _SOUND
    + """SELECT i.src AS node, CAST(count(*) AS BIGINT) AS pairs, round(sum(o.weight), 4) AS left_sum, round(sum(i.weight), 4) AS right_sum
FROM (SELECT src AS mid, weight FROM sound) o JOIN (SELECT dst AS mid, src, weight FROM sound) i USING (mid) GROUP BY i.src"""
)
def p4_two_step_paths(spark, d):
    sound = hot_keys.sound_edges(read(spark, d, "edges"))
    out = sound.select(F.col("src").alias("mid"), "weight")
    into = sound.select(F.col("dst").alias("mid"), F.col("src").alias("node"), "weight")
    total = hot_keys.join_totals(out, into, "mid", "weight", "weight", by=["node"])
    return total.select("node", "pairs", F.round("left_sum", 4).alias("left_sum"), F.round("right_sum", 4).alias("right_sum"))


# ---- the embeddings table as data matrix, its neighbour graph as edges, its first coordinates as an embedding


def _items(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def _points(spark, d, m=2):
    return _items(spark, d).select("id", F.slice("x", 1, m).alias("x"))


def _edges(spark, d, k=5):
    return knn.knn_edges(knn.knn(_items(spark, d), k))


def _weighted(spark, d):
    w = ((F.col("src") * 7 + F.col("dst") * 3) % 11 - 5) / 2.0
    u = F.lit(0.2) + (F.col("src") + F.col("dst")) % 7 * 0.2
    return materialize(_edges(spark, d).select("src", "dst", w.alias("w"), u.alias("u")))


def _graph(spark, d):
    """Neighbour graph with distances as weights."""
    near = knn.knn(_items(spark, d), 5)
    edges = near.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max(F.round("distance", 6)).alias("weight"))
    return Graph(materialize(edges), _items(spark, d).count())


def _hops(spark, d):
    g = _graph(spark, d)
    return Graph(g.edges.withColumn("weight", F.lit(1.0)), g.n_items)


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


_KNN = """
it AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
near AS (SELECT * FROM (SELECT a.id AS src, b.id AS dst, list_distance(a.x, b.x) AS d,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM it a JOIN it b ON a.id <> b.id) WHERE r <= 5),
e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(count(*) AS DOUBLE) AS weight, round(max(d), 6) AS dist FROM near GROUP BY ALL),
p AS (SELECT id, x[1] AS x1, x[2] AS x2, x[3] AS x3 FROM it),
g AS (SELECT e.src, e.dst, a.x1 - b.x1 AS d1, a.x2 - b.x2 AS d2, sqrt((a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) AS d,
    ((e.src * 7 + e.dst * 3) % 11 - 5) / 2.0 AS w, 0.2 + (e.src + e.dst) % 7 * 0.2 AS u
  FROM e JOIN p a ON e.src = a.id JOIN p b ON e.dst = b.id)
"""


@query(_SOUND + "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(sum(weight), 4) AS weight FROM sound GROUP BY ALL HAVING sum(weight) <> 0")
def graph_from_edges(spark, d):
    return Graph.from_edges(hot_keys.sound_edges(read(spark, d, "edges"))).edges.select("src", "dst", _r("weight", 4).alias("weight"))


@query(
    _SOUND
    + """, g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM sound GROUP BY ALL HAVING sum(weight) <> 0)
SELECT CASE WHEN a = 0 THEN b ELSE a END AS neighbour, round(w, 4) AS distance FROM g WHERE a = 0 OR b = 0"""
)
def graph_neighbors(spark, d):
    g = Graph.from_edges(hot_keys.sound_edges(read(spark, d, "edges")))
    return g.neighbours(0).select("neighbour", _r("distance", 4).alias("distance"))


@query(
    _SOUND
    + """, g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM sound GROUP BY ALL HAVING sum(weight) <> 0)
SELECT id, count(*) AS degree, round(sum(w), 3) AS strength FROM (SELECT a AS id, w FROM g UNION ALL SELECT b, w FROM g) GROUP BY id"""
)
def graph_degree(spark, d):
    g = Graph.from_edges(hot_keys.sound_edges(read(spark, d, "edges")))
    return g.degrees().select("id", "degree", _r("strength", 3).alias("strength"))


@query(f"WITH {_KNN} SELECT round((SELECT count(*) FROM e) / (n * (n - 1) / 2.0), 9) AS density FROM (SELECT count(*) AS n FROM it)")
def edge_density(spark, d):
    g = Graph(_edges(spark, d), _items(spark, d).count())
    return spark.createDataFrame([(round(g.density(), 9),)], "density double")


@query(
    f"""WITH {_KNN} SELECT src AS row, dst AS col, round(-dist, 6) AS value FROM e UNION ALL SELECT dst, src, round(-dist, 6) FROM e
UNION ALL SELECT id, id, round(sum(dist), 6) FROM (SELECT src AS id, dist FROM e UNION ALL SELECT dst, dist FROM e) GROUP BY id"""
)
def laplacian_matrix(spark, d):
    return _graph(spark, d).laplacian().select("row", "col", _r("value").alias("value"))


@query("SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def all_pairs(spark, d):
    return pairs.all_pairs(spark, read(spark, d, "embeddings").count())


@query(
    """SELECT CAST(row_number() OVER (ORDER BY a.vec_id, b.vec_id) - 1 AS BIGINT) AS e, a.vec_id AS src, b.vec_id AS dst
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"""
)
def pair_decode_triangular(spark, d):
    n = read(spark, d, "embeddings").count()
    u, v = pairs.decode(F.col("id"), n)
    return spark.range(pairs.n_pairs(n)).select(F.col("id").alias("e"), u.alias("src"), v.alias("dst"))


@query("SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL")
def dedup_edges(spark, d):
    return pairs.canonical(read(spark, d, "edges"))


@query(f"WITH {_KNN} SELECT a.id AS src, b.id AS dst FROM it a JOIN it b ON a.id < b.id EXCEPT SELECT src, dst FROM e")
def complement_edges(spark, d):
    return pairs.complement(spark, read(spark, d, "embeddings").count(), _edges(spark, d))


_SAMPLE = """
, c AS (SELECT count(*) AS n, (SELECT count(*) FROM e) AS m FROM it), k AS (SELECT n, m, n * (n - 1) // 2 AS total FROM c),
num AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (ORDER BY a.id, b.id) - 1 AS e FROM it a JOIN it b ON a.id < b.id),
draws AS (SELECT i AS id, CAST('0x' || substr(md5(i || '-0'), 1, 15) AS BIGINT) % total AS e FROM k, range(0, 400000) r(i)
  WHERE i < {draws}),
firsts AS (SELECT e, min(id) AS id FROM draws GROUP BY e)
"""
_MANY = "ceil(m * total / (total - m) * 1.05) + 64"
_DRAWS = "ceil(-total * ln(1 - least(({m}) / total, 0.75)) * 1.1 + 8 * sqrt({m}) + 64)"


@query(
    f"WITH {_KNN}" + _SAMPLE.format(draws=_DRAWS.format(m=_MANY))
    + "SELECT n.src, n.dst FROM firsts f JOIN num n ON f.e = n.e WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = n.src AND e.dst = n.dst) ORDER BY f.id LIMIT (SELECT m FROM k)"
)
def dissimilar_edges(spark, d):
    return pairs.dissimilar_edges(spark, read(spark, d, "embeddings").count(), _edges(spark, d))


@query(
    f"WITH {_KNN}" + _SAMPLE.format(draws=_DRAWS.format(m="m"))
    + ", picked AS (SELECT n.src, n.dst FROM firsts f JOIN num n ON f.e = n.e ORDER BY f.id LIMIT (SELECT m FROM k)) SELECT src, dst FROM picked EXCEPT SELECT src, dst FROM e"
)
def sample_edges(spark, d):
    e = materialize(_edges(spark, d))
    return pairs.sample_edges(spark, read(spark, d, "embeddings").count(), e.count(), e)


@query(f"WITH {_KNN} SELECT a.id AS src, b.id AS dst, round(list_distance(a.x, b.x), 6) AS distance FROM it a JOIN it b ON a.id < b.id WHERE list_distance(a.x, b.x) <> 0")
def pairwise_distances(spark, d):
    return distances.pairwise(spark, _items(spark, d)).select("src", "dst", _r("distance").alias("distance"))


@query(f"WITH {_KNN} SELECT src, dst, round(dist * 2.5 / (SELECT sqrt(avg(dist * dist)) FROM e), 6) AS weight FROM e")
def scaled_deviations_rms(spark, d):
    return _graph(spark, d).scaled(2.5).edges.select("src", "dst", _r("weight").alias("weight"))


@query(f"WITH {_KNN} SELECT src, dst, weight FROM e")
def knn_graph(spark, d):
    return _edges(spark, d)


@query(f"WITH {_KNN} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM near WHERE d <= 1.1 GROUP BY ALL")
def knn_max_distance(spark, d):
    return knn.knn_edges(knn.knn(_items(spark, d), 5), 1.1)


@query(f"WITH {_KNN} SELECT round(3 * quantile_cont(dist, 0.75), 6) AS radius FROM e")
def radius_q75(spark, d):
    return radius(_graph(spark, d).edges).select(_r("radius").alias("radius"))


@query(f"WITH {_KNN} SELECT src, dst, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM g")
def differences(spark, d):
    out = distances.differences(_edges(spark, d), _points(spark, d))
    return out.select("src", "dst", _r(F.element_at("diff", 1)).alias("d1"), _r(F.element_at("diff", 2)).alias("d2"))


@query(f"WITH {_KNN} SELECT src, dst, round(d, 6) AS distance FROM g")
def edge_distances(spark, d):
    return distances.with_distance(_edges(spark, d), _points(spark, d)).select("src", "dst", _r("distance").alias("distance"))


def _kernel(name: str, kernel: K.Kernel, sql: str, negative: bool = False):
    def run(spark, d):
        e = _weighted(spark, d)
        weight = "u" if kernel.on == "deviation" else "w"
        if negative:
            e = e.withColumn("w", -F.abs("w") - 0.1)
        out = distances.distortions(e, _points(spark, d), kernel, weight)
        return out.select("src", "dst", _r("distortion").alias("distortion"))

    run.__name__ = name
    w = "(-abs(w) - 0.1)" if negative else "w"
    query(f"WITH {_KNN} SELECT src, dst, round({sql}, 6) AS distortion FROM (SELECT src, dst, d, u, {w} AS w FROM g)")(run)


_P9, _P12 = "w * ln(1 + pow(d, 1.5))", "w * ln(d * d / (1 + d * d))"
for _name, _k, _sql in [
    ("pen_linear", K.linear(), "w * d"),
    ("pen_quadratic", K.quadratic(), "w * d * d"),
    ("pen_cubic", K.cubic(), "w * pow(d, 3)"),
    ("pen_power", K.power(1.7), "w * pow(d, 1.7)"),
    ("pen_huber", K.huber(0.5), "CASE WHEN d < 0.5 THEN 0.5 * w * d * d ELSE w * 0.5 * (d - 0.25) END"),
    ("pen_logistic", K.logistic(), "w * (greatest(3 * d, 0) + ln(1 + exp(-abs(3 * d))))"),
    ("pen_sigmoid", K.sigmoid(0.4), "w / (1 + exp(-(d - 0.4)))"),
    ("pen_hinge", K.hinge(0.4), "greatest(0, w * (d - (0.4 - sign(w) * 0.2)))"),
    ("pen_log1p", K.log1p(), _P9),
    ("pen_log", K.log(), "w * ln(1 - exp(-d))"),
    ("pen_inv_power", K.inv_power(), "abs(w) / d"),
    ("pen_log_ratio", K.log_ratio(), _P12),
    ("pen_push_and_pull", K.push_and_pull(), f"CASE WHEN w >= 0 THEN {_P9} ELSE {_P12} END"),
    ("pen_deadzone_quadratic", K.deadzone_quadratic(0.5), "CASE WHEN d < 0.5 THEN 0 ELSE w * d * d END"),
    ("pen_deadzone_cubic", K.deadzone_cubic(0.5), "CASE WHEN d < 0.5 THEN 0 ELSE w * pow(d, 3) END"),
    ("pen_clipped_quadratic", K.clipped_quadratic(0.5), "w * least(d * d, 2.25)"),
    ("loss_quadratic", K.loss_quadratic(), "pow(d - u, 2)"),
    ("loss_weighted_quadratic", K.loss_weighted_quadratic(), "pow(d - u, 2) / (u * u)"),
    ("loss_huber", K.loss_huber(0.3), "CASE WHEN abs(d - u) < 0.3 THEN pow(d - u, 2) ELSE 0.3 * (2 * abs(d - u) - 0.3) END"),
    ("loss_cubic", K.loss_cubic(), "pow(abs(d - u), 3)"),
    ("loss_power", K.loss_power(1.5), "pow(abs(d - u), 1.5)"),
    ("loss_absolute", K.loss_absolute(), "abs(d - u)"),
    ("loss_logistic", K.loss_logistic(), "ln(1 + exp(abs(d - u)))"),
    ("loss_fractional", K.loss_fractional(), "greatest(u / d, d / u) - 1"),
    ("loss_soft_fractional", K.loss_soft_fractional(), "greatest(u / d, d / u) + ln(1 + exp(-10 * abs(u / d - d / u))) / 10 - ln(2) / 10 - 1"),
    ("loss_clipped_quadratic", K.loss_clipped_quadratic(0.5), "least(pow(d - u, 2), 2.25)"),
    ("loss_weighted_power", K.loss_weighted_power(1.5), "pow(abs(d - u), 1.5) / (u * u)"),
    ("loss_log1p", K.loss_log1p(2), "ln(1 + pow(d - u, 2))"),
]:
    _kernel(_name, _k, _sql, negative=_name == "pen_inv_power")


@query(f"WITH {_KNN} SELECT round(avg({_P9}), 6) AS average_distortion FROM g")
def average_distortion(spark, d):
    return distances.average_distortion(_weighted(spark, d), _points(spark, d), K.log1p(), "w").select(_r("average_distortion").alias("average_distortion"))


@query(
    f"""WITH {_KNN}, s AS (SELECT src, dst, d1, d2, w * 1.5 * pow(d, 0.5) / (1 + pow(d, 1.5)) / d / (SELECT count(*) FROM g) AS k FROM g)
SELECT id, round(sum(g1), 6) AS g1, round(sum(g2), 6) AS g2 FROM (SELECT src AS id, k * d1 AS g1, k * d2 AS g2 FROM s UNION ALL SELECT dst, -k * d1, -k * d2 FROM s) GROUP BY id"""
)
def distortion_gradient(spark, d):
    g = distances.gradient(_weighted(spark, d), _points(spark, d), K.log1p(), "w")
    return g.select("id", _r(F.element_at("gradient", 1)).alias("g1"), _r(F.element_at("gradient", 2)).alias("g2"))


def _distorted(spark, d):
    return distances.distortions(_weighted(spark, d), _points(spark, d), K.loss_absolute(), "u")


@query(f"WITH {_KNN} SELECT src, dst, round(abs(d - u), 6) AS distortion FROM g ORDER BY abs(d - u) DESC, src, dst LIMIT 10")
def high_distortion_pairs(spark, d):
    return diagnostics.extreme_pairs(_distorted(spark, d), 10).select("src", "dst", _r("distortion").alias("distortion"))


@query(f"WITH {_KNN} SELECT src, dst, round(abs(d - u), 6) AS distortion FROM g ORDER BY abs(d - u), src, dst LIMIT 10")
def low_distortion_pairs(spark, d):
    return diagnostics.extreme_pairs(_distorted(spark, d), 10, highest=False).select("src", "dst", _r("distortion").alias("distortion"))


@query(
    f"""WITH {_KNN}, r AS (SELECT abs(d - u) AS v, row_number() OVER (ORDER BY abs(d - u), src, dst) AS k, count(*) OVER () AS n FROM g)
SELECT round(v, 6) AS value, round(k / n, 9) AS share FROM r"""
)
def distortion_cdf(spark, d):
    return diagnostics.cdf(_distorted(spark, d)).select(_r("value").alias("value"), F.round("share", 9).alias("share"))


def _flat(df, m):
    return df.select("id", *(_r(F.element_at("x", k + 1)).alias(f"x{k + 1}") for k in range(m)))


@query(f"WITH {_KNN} SELECT id, round(x1 - (SELECT avg(x1) FROM p), 6) AS x1, round(x2 - (SELECT avg(x2) FROM p), 6) AS x2 FROM p")
def center(spark, d):
    return _flat(transform.center(_points(spark, d)), 2)


@query(f"WITH {_KNN} SELECT id, round(x1 * cos(radians(30)) + x2 * sin(radians(30)), 6) AS x1, round(x2 * cos(radians(30)) - x1 * sin(radians(30)), 6) AS x2 FROM p")
def rotate2d(spark, d):
    return _flat(transform.rotate(_points(spark, d), 30), 2)


@query(
    f"""WITH {_KNN}, a AS (SELECT id, x1, x2 * cos(radians(10)) - x3 * sin(radians(10)) AS x2, x2 * sin(radians(10)) + x3 * cos(radians(10)) AS x3 FROM p),
b AS (SELECT id, x1 * cos(radians(20)) + x3 * sin(radians(20)) AS x1, x2, x3 * cos(radians(20)) - x1 * sin(radians(20)) AS x3 FROM a)
SELECT id, round(x1 * cos(radians(30)) - x2 * sin(radians(30)), 6) AS x1, round(x1 * sin(radians(30)) + x2 * cos(radians(30)), 6) AS x2, round(x3, 6) AS x3 FROM b"""
)
def rotate3d(spark, d):
    return _flat(transform.rotate(_points(spark, d, 3), (10, 20, 30)), 3)


@query(
    f"""WITH {_KNN} SELECT 0 AS a, 0 AS b, round(sum(x1 * x1) / count(*), 6) AS value FROM p UNION ALL
SELECT 0, 1, round(sum(x1 * x2) / count(*), 6) FROM p UNION ALL SELECT 1, 1, round(sum(x2 * x2) / count(*), 6) FROM p"""
)
def gram(spark, d):
    return transform.gram(_points(spark, d)).select("a", "b", _r("value").alias("value"))


@query("SELECT round(sqrt(2.0 * n * 2 / (n - 1)), 9) AS natural_length FROM (SELECT count(*) AS n FROM embeddings)")
def natural_length(spark, d):
    n = read(spark, d, "embeddings").count()
    return spark.createDataFrame([(round(transform.natural_length(n, 2), 9),)], "natural_length double")


@query(f"WITH {_KNN} SELECT id, round(x1 / sqrt(x1 * x1 + x2 * x2) * 2, 6) AS x1, round(x2 / sqrt(x1 * x1 + x2 * x2) * 2, 6) AS x2 FROM p")
def sphere_project(spark, d):
    return _flat(transform.on_sphere(_points(spark, d), 2.0), 2)


@query(f"WITH {_KNN}, k AS (SELECT vec_id AS id FROM embeddings WHERE label = 0) SELECT src, dst, weight FROM e WHERE NOT (src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))")
def anchor_edge_filter(spark, d):
    anchors = read(spark, d, "embeddings").where("label = 0").select(F.col("vec_id").alias("id"))
    return pairs.without_anchored(_edges(spark, d), anchors)


_STANDING_POINTS = """
last AS (SELECT id, x FROM (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY solved_at DESC NULLS LAST, x DESC) AS rn FROM embedding WHERE id IS NOT NULL) WHERE rn = 1)
"""


def _standing_points(spark, d):
    rows = read(spark, d, "embedding").where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("solved_at", "x")).alias("r"))
    return rows.select("id", F.col("r.x").alias("x"))


_NUMBER = "CASE WHEN isnan({0}) THEN NULL ELSE round({0}, 6) END"


@query(f"WITH {_STANDING_POINTS} SELECT l.id, {_NUMBER.format('coalesce(a.x, l.x)[1]')} AS x1, {_NUMBER.format('coalesce(a.x, l.x)[2]')} AS x2 FROM last l LEFT JOIN anchors a USING (id)")
def anchor_apply(spark, d):
    pinned = _flat(transform.pin(_standing_points(spark, d), read(spark, d, "anchors")), 2)
    return pinned.select("id", *(F.nullif(c, F.lit(float("nan"))).alias(c) for c in ("x1", "x2")))  # Spark's NaN equals itself


@query(
    _SOUND.replace("WITH ", f"WITH {_STANDING_POINTS.strip()}, ", 1)
    + """, sure AS (SELECT id, x FROM last WHERE NOT isnan(x[1]) AND NOT isnan(x[2]))
SELECT count(*) AS n, round(avg(ln(1 + pow(list_distance(a.x, b.x), 1.5))), 6) AS average_distortion FROM sound s JOIN sure a ON s.src = a.id JOIN sure b ON s.dst = b.id"""
)
def edges_average_distortion(spark, d):
    sure = _standing_points(spark, d).where("NOT isnan(x[0]) AND NOT isnan(x[1])")
    e = hot_keys.sound_edges(read(spark, d, "edges")).withColumn("w", F.lit(1.0))
    return distances.distortions(e, sure, K.log1p(), "w").agg(F.count("*").alias("n"), _r(F.avg("distortion")).alias("average_distortion"))


@query("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer")
def label_codes(spark, d):
    return diagnostics.label_codes(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer)")
def feature_prep_standard_scale(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return transform.standard_scale(rows, ["c_acctbal"]).select("c_custkey", _r("c_acctbal").alias("c_acctbal"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def feature_join(spark, d):
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")


_BOTH = "b AS (SELECT src, dst, dist FROM e UNION ALL SELECT dst, src, dist FROM e)"


@query(
    f"""WITH RECURSIVE {_KNN}, {_BOTH}, reach AS (SELECT src, dst, 1 AS h FROM b UNION SELECT r.src, b.dst, h + 1 FROM reach r JOIN b ON r.dst = b.src WHERE h < 3)
SELECT src, dst, CAST(min(h) AS DOUBLE) AS weight FROM reach WHERE src < dst GROUP BY ALL"""
)
def shortest_paths_hops(spark, d):
    return paths.shortest_paths(_hops(spark, d), 3).edges


_WEIGHTED = f"""WITH RECURSIVE {_KNN}, {_BOTH}, reach AS (SELECT 1 AS h, src, dst, dist FROM b UNION ALL
  SELECT h + 1, r.src, b.dst, min(r.dist + b.dist) FROM reach r JOIN b ON r.dst = b.src AND r.src <> b.dst WHERE h < 4 AND r.dist + b.dist <= 2.4 GROUP BY h, r.src, b.dst),
path AS (SELECT src, dst, min(dist) AS dist FROM reach WHERE dist <= 2.4 GROUP BY ALL)
"""


@query(_WEIGHTED + "SELECT src, dst, round(dist, 6) AS weight FROM path WHERE src < dst")
def shortest_paths_weighted(spark, d):
    return paths.shortest_paths(_graph(spark, d), 2.4).edges.select("src", "dst", _r("weight").alias("weight"))


@query(_WEIGHTED + "SELECT src, dst, round(dist, 6) AS weight FROM path WHERE src < dst")
def shortest_paths_by_joins(spark, d):
    return paths.relax(_graph(spark, d).edges, 2.4).select("src", "dst", _r("weight").alias("weight"))


@query(
    _WEIGHTED
    + """, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS k FROM path)
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM r WHERE k <= 8 GROUP BY ALL"""
)
def graph_knn(spark, d):
    return paths.graph_knn(_graph(spark, d), 8, 2.4)


# ---- solves: checked by invariants in the tests, as SQL has no iteration over matrices


@query()
def spanning_forest(spark, d):
    return paths.spanning_forest(_graph(spark, d))


@query()
def project_standardized(spark, d):
    return transform.standardize(_points(spark, d))


@query()
def align(spark, d):
    return transform.align(transform.rotate(_points(spark, d), 40), _points(spark, d))


@query()
def pca(spark, d):
    return spectral_plans.pca(_items(spark, d), 3)


@query()
def spectral(spark, d):
    return spectral_plans.spectral(_graph(spark, d), 2)


@query()
def preserve_neighbors(spark, d):
    return recipes.preserve_neighbors(_items(spark, d)).embed()


@query()
def preserve_distances(spark, d):
    return recipes.preserve_distances(_items(spark, d)).embed()


@query()
def laplacian_embedding(spark, d):
    return recipes.laplacian_embedding(_items(spark, d)).embed()


@query()
def draw_graph(spark, d):
    return recipes.draw(_hops(spark, d)).embed()


@query()
def solve_stats(spark, d):
    problem = recipes.preserve_neighbors(_items(spark, d))
    problem.embed(snapshot_every=25)
    return problem.solve_stats()


@query()
def embed_distributed(spark, d):
    problem = recipes.preserve_neighbors(_items(spark, d))
    return problem.embed(local=False)


@query()
def embed_stochastic(spark, d):
    return recipes.preserve_neighbors(_items(spark, d)).embed(batch_size=1000)


@query()
def embed_by_tables(spark, d):
    e = materialize(_edges(spark, d))
    return solver.descend(e, _points(spark, d), K.log1p())


@query()
def embed_incremental(spark, d):
    items = materialize(_items(spark, d))
    cut = items.count() * 9 // 10
    problem = recipes.preserve_neighbors(items.where(F.col("id") < cut))
    return incremental.place(items.where(F.col("id") >= cut), items.where(F.col("id") < cut), problem.embed())


@query()
def ann_knn(spark, d):
    return knn.knn_approximate(_items(spark, d), 10, 44).select("src", "dst", "rank")
