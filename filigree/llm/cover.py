"""A varied subset of given size: multi-attribute grid round-robin, in SQL only.

Binning. Every feature is binned (bins of four radii); the records of one combination of bins are a cell, and the one
of smallest id stands for it. A record farther than a radius from its cell's stand-in is a cell of its own. A cluster
that bin borders cut is still one place to cover, so cells are joined (minimum labels) whose stand-ins are alike to each
other or to a member of the other. To find those, cells are looked up in a coarser grid of a few features (grid.py): a stand-in meets those of its own and of
touching coarse cells whose occupied box it can reach.

Round-robin. Records are ranked within their cell, those of joined cells by that rank in turn, then all by rank and
cell, and the first k are kept. So each joined cell gives one record before any gives a second, whatever its size. All
orders are by md5, so the result depends on ids only.

Which items are alone. An item that stands for a cell of its own, and whose cell was joined with no other, can only be
alike to a member of a cell whose stand-in is nearly alike; it is compared with the members of those cells.

Sizes. A cell with more than SPLIT records is cut in parts by a hash, each with a stand-in. Ranks beyond those that any
place can have (they follow from the sizes of the cells) are dropped in salted parts before the ranking, and places are
counted by ranges of the order, so no task sorts a data set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.grid import AXES, CELL, COORDS, axes, distance, gap, named, squared, touching, with_cells
from filigree.operators.components import min_labels
from filigree.session import materialize, release

SPLIT = 50_000
WIDE = 4.0
PREFIX = 12


def top(rows: DataFrame, keys: list[str], order: list, limit: str, name: str, salts: Column | int = 32, most: int | None = None) -> DataFrame:
    """The first `limit` (a column) rows of each key by order, with their place as `name`. A key is first cut in
    `salts` parts, so that no task sorts more than a part of it and then the parts' first rows. most: a number that no
    limit exceeds, if known, by which Spark can stop within a part."""
    n = F.lit(salts) if isinstance(salts, int) else salts
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id", F.lit(7)), n.cast("bigint")))
    bound = lambda t: (t if most is None else t.where(F.col(name) <= most)).where(F.col(name) <= F.col(limit))
    part = bound(salted.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))))
    return bound(part.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))).drop("_salt")


def requested(requests: DataFrame) -> DataFrame:
    """(dataset_id, k): the largest size asked of a data set; null or non-positive sizes ask for nothing."""
    return requests.where("dataset_id IS NOT NULL AND subset_size > 0").groupBy("dataset_id").agg(F.max("subset_size").cast("bigint").alias("k"))


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws("-", *(p if isinstance(p, Column) else F.col(p) for p in parts)))


class Cells:
    """The cells of the requested data sets' items.

    items: (cell of the coarse grid, part, id, far, settled, features), part being the id of the stand-in, far the
    distance from it and settled whether that is at most the radius. stands: one row per stand-in, its own part
    included, with mates (settled members) and reach (the farthest of them).
    """

    def __init__(self, usable: DataFrame, requests: DataFrame, radius: float = 1.0, sample: DataFrame | None = None):
        self.radius, width = radius, WIDE * radius
        self.wanted = requested(requests)
        asked = usable.join(self.wanted.select("dataset_id"), "dataset_id", "left_semi")
        self.grid = materialize(axes(asked if sample is None else sample, width))
        bins = F.xxhash64(F.transform("features", lambda v: F.floor(v / width)))
        binned = materialize(with_cells(asked, self.grid, width).withColumn("bin", bins))
        total = binned.count()
        crowded = binned.groupBy("dataset_id", "bin").agg(F.ceil(F.count("*") / SPLIT).alias("parts")).where("parts > 1")
        if total // SPLIT <= 200_000:  # no more crowded cells than that
            crowded = F.broadcast(crowded)
        each = binned.join(crowded, ["dataset_id", "bin"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)).cast("bigint")))
        first = Window.partitionBy("dataset_id", "bin", "salt").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        each = each.withColumn("rep", F.first("id").over(first)).withColumn("rep_x", F.first("features").over(first))
        each = each.withColumn("far", distance("features", "rep_x")).withColumn("settled", (F.col("id") != F.col("rep")) & (F.col("far") <= radius))
        part = F.when(F.col("settled"), F.col("rep")).otherwise(F.col("id")).alias("part")
        self.items = materialize(each.select(*CELL, "g", part, "id", "far", "settled", "features"))
        release(binned)
        mates = self.items.where("settled").groupBy("part").agg(F.count("*").alias("mates"), F.max("far").alias("reach"))
        stands = self.items.where("NOT settled").drop("part", "far", "settled").join(mates, F.col("id") == F.col("part"), "left").drop("part")
        stands = stands.withColumn("mates", F.coalesce("mates", F.lit(0))).withColumn("reach", F.coalesce("reach", F.lit(0.0)))
        at = [f"get(features, get(axes, {k})) AS p{k}" for k in range(AXES)]
        self.stands = materialize(stands.join(self.grid.select("dataset_id", "axes"), "dataset_id").selectExpr(*stands.columns, *at))
        self.links = materialize(self._met(self.stands, self.stands, "0D").where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))

    def _met(self, a: DataFrame, b: DataFrame, more: str) -> DataFrame:
        """(a_id, a_features, b_id): stand-ins of a and b in the same or touching coarse cells that are at most the
        radius plus `more` (SQL over b's b_reach) apart, more being at most the radius."""
        edges = [f"{s}{k}" for s in ("lo", "hi") for k in range(AXES)]
        box = F.expr(f"struct({', '.join(f'min(p{k}) AS lo{k}, max(p{k}) AS hi{k}' for k in range(AXES))}, max(reach) AS reach)").alias("box")
        own = a.select(*CELL, "g").union(b.select(*CELL, "g")).distinct()
        cells = own.join(b.groupBy(*CELL).agg(box), CELL, "left").select(*own.columns, "box.*")
        pairs = touching(cells, [*edges, "reach"], half=False).where("b_reach IS NOT NULL")
        pairs = pairs.selectExpr(*(f"a_{c} AS {c}" for c in CELL), *(f"b_{c}" for c in [*COORDS, *edges, "reach"]))
        limit = f"pow({self.radius}D + {more}, 2) * {1 + 1e-9}D"
        near = a.join(pairs, CELL).where(f"{gap('p{k}', 'p{k}', 'b_lo{k}', 'b_hi{k}')} <= {limit}")
        near = near.selectExpr("dataset_id", *(f"b_{c}" for c in COORDS), "id AS a_id", "features AS a_features")
        there = b.selectExpr("dataset_id", *named("b", [*COORDS, "id", "reach", "features"]))
        both = near.join(there, ["dataset_id", *(f"b_{c}" for c in COORDS)]).where("a_id <> b_id")
        close = both.where(squared("a_features", "b_features", PREFIX) <= F.expr(limit)).where(distance("a_features", "b_features") <= F.expr(f"{self.radius}D + {more}"))
        return close.select("a_id", "a_features", "b_id")

    def alone(self) -> DataFrame:
        """(dataset_id, id) of the items alike to no other item of their data set, copies included."""
        linked = self.links.select(F.col("a").alias("id")).union(self.links.select("b"))
        single = materialize(self.stands.where("mates = 0").join(linked, "id", "left_anti"))
        others = self.stands.where("mates > 0")
        maybe = materialize(self._met(single, others, "b_reach").select("a_id", "a_features", F.col("b_id").alias("part")))
        members = self.items.where("settled").select("part", F.col("features").alias("b_features"))
        hit = maybe.join(members, "part").where(distance("a_features", "b_features") <= self.radius).select(F.col("a_id").alias("id")).distinct()
        return single.select("dataset_id", "id").join(hit, "id", "left_anti").select("dataset_id", "id")

    def labelled(self) -> DataFrame:
        """(dataset_id, label, part, id): equal labels iff the parts are connected by stand-ins that are alike to each
        other or to a member of the other part. Members are only looked at where labels still differ."""
        label = materialize(min_labels(self.links))
        of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
        maybe = self._met(self.stands, self.stands.where("mates > 0"), "b_reach").withColumnRenamed("b_id", "part")
        maybe = maybe.join(of("a_id"), "a_id", "left").join(of("part"), "part", "left")
        maybe = materialize(maybe.selectExpr("part", "a_features", "coalesce(l_a_id, a_id) AS a", "coalesce(l_part, part) AS b").where("a <> b"))
        members = self.items.where("settled").select("part", F.col("features").alias("b_features"))
        near = maybe.join(members, "part").where(squared("a_features", "b_features", PREFIX) <= self.radius**2 * (1 + 1e-9))
        hit = near.where(distance("a_features", "b_features") <= self.radius).select("a", "b").distinct()
        label = min_labels(self.links.unionByName(hit)).select(F.col("node").alias("part"), "label")
        each = self.items.select("dataset_id", "part", "id").join(label, "part", "left")
        return each.select("dataset_id", F.coalesce("label", "part").alias("label"), "part", "id")


def round_robin(usable: DataFrame, requests: DataFrame, radius: float = 1.0, sample: DataFrame | None = None) -> DataFrame:
    """(dataset_id, id, place): the subset of each requested data set; place is 1..k.

    usable: (dataset_id, id, features) without repeated ids. A data set with no more than k items gives all of them;
    one without items gives none. sample: rows to choose the coarse grid by (grid.axes).
    """
    cells = Cells(usable, requests, radius, sample)
    items = materialize(cells.labelled())
    sizes = items.groupBy("dataset_id", "label").agg(F.count("*").alias("n"))
    # the last rank that gets a place: with h cells of n records or more, ranks up to n take the sum of min(size, n)
    steps = sizes.groupBy("dataset_id", "n").agg(F.count("*").alias("h"))
    upto = Window.partitionBy("dataset_id").orderBy("n")
    after = Window.partitionBy("dataset_id").orderBy(F.col("n").desc())
    steps = steps.withColumn("less", F.sum(F.col("n") * F.col("h")).over(upto) - F.col("n") * F.col("h")).withColumn("more", F.sum("h").over(after))
    steps = steps.withColumn("full", F.col("less") + F.col("n") * F.col("more")).join(cells.wanted, "dataset_id")
    enough = steps.where("full >= k").groupBy("dataset_id").agg(F.min(F.struct("n", "full", "more", "k")).alias("m"))
    cut = enough.select("dataset_id", (F.col("m.n") - F.floor((F.col("m.full") - F.col("m.k")) / F.col("m.more"))).alias("deep"))
    cut = cells.wanted.join(cut, "dataset_id", "left").select("dataset_id", "k", F.coalesce("deep", F.col("k")).cast("bigint").alias("deep"))
    cut = materialize(cut)
    most = cut.agg(F.max("deep")).first()[0] or 1
    rows = items.join(cut, "dataset_id").join(sizes, ["dataset_id", "label"]).withColumn("_salts", F.ceil(F.col("n") / SPLIT))
    mine = [_hash("dataset_id", "id"), F.col("id")]
    turns = top(rows, ["dataset_id", "part"], mine, "deep", "turn", F.col("_salts"), most)
    in_turn = [F.col("turn"), _hash(F.lit("part"), "part"), F.col("id")]
    ranked = top(turns, ["dataset_id", "label"], in_turn, "deep", "rank", F.col("_salts"), most)
    ranked = materialize(ranked.select("dataset_id", "id", "rank", "k", _hash(F.lit("label"), "dataset_id", "label").alias("h")))
    # places by ranges of the order: the first two digits of the hash of the cell
    slot = ["dataset_id", "rank", "slot"]
    ranged = ranked.withColumn("slot", F.substring("h", 1, 2))
    before = Window.partitionBy("dataset_id").orderBy("rank", "slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.groupBy(*slot).agg(F.count("*").alias("_n")).select(*slot, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = F.row_number().over(Window.partitionBy(*slot).orderBy("h", "id"))
    placed = ranged.withColumn("_r", inside).join(offset, slot).withColumn("place", (F.col("_r") + F.col("_from")).cast("int"))
    return placed.where("place <= k").select("dataset_id", "id", "place")


def only_by_themselves(usable: DataFrame, requests: DataFrame, radius: float = 1.0, sample: DataFrame | None = None) -> DataFrame:
    """(dataset_id, id) of the items of the requested data sets that are alike to no other item, hence have a cell of
    the round-robin to themselves: a subset covers them only by choosing them."""
    return Cells(usable, requests, radius, sample).alone()
