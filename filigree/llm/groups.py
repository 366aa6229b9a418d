"""Groups of alike items: grid density clustering with exact checks.

Method. Features are quantised to the cells of a grid (grid.py) and the cells are counted. A cell is dense if it and the
cells that touch it hold at least `least` items. As cells are (least - 1) radii wide, all members of a group of that
size lie in dense cells: from any member, least - 1 others are reached by so many steps of at most a radius. Touching
dense cells whose occupied boxes are within the radius are joined, and minimum labels spread over the links until no
link can move. These steps are SQL.

The exact check. Cells in all 20 to 28 features would hold single items only, so the grid takes few features and
distances over all of them decide. Within a cell, the components of alike items are found at once and covered by balls
of half a radius round some of the items. Between joined cells, components are linked if two ball centres are alike;
components that this leaves apart, though their balls are so near that members may be alike, are compared member by
member, unless labels already join them.

Sizes. A crowded cell is split into chunks of about CHUNK items by a hash of the id, so that no task meets an unbounded
cell; its chunks are linked as cells are. Only balls go through the join of cells: a group of copies is one ball per
chunk. Nothing is collected but single numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.grid import AXES, CELL, COORDS, axes, gap, named, touching, with_cells
from filigree.operators.components import min_labels
from filigree.session import materialize, release

CHUNK = 2048
BLOCK = 1024
ROWS_PER_TASK = 8192
MEMBER = ", ".join([*(f"{c} bigint" for c in CELL), "g int", "chunks int", "id bigint", "comp bigint", "ball bigint", "reach double", "off double", "features array<double>"])


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by the product form, from a common origin, and a bound of their error."""
    o = x[:1] if len(x) else y[:1]
    x, y = x - o, y - o
    a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    d = a[:, None] + b[None, :]
    d -= 2.0 * (x @ y.T)
    return np.maximum(d, 0.0, out=d), 1e-13 * (1.0 + a.max(initial=0) + b.max(initial=0)) * (4 + x.shape[1])


def _within(x: np.ndarray, y: np.ndarray, d2: np.ndarray, error: float, radius: float) -> np.ndarray:
    """Which pairs are at most radius apart; pairs too close to call are computed by differences."""
    near = d2 <= radius * radius
    i, j = np.nonzero(np.abs(d2 - radius * radius) <= error)
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        near[i[s], j[s]] = np.sqrt(((x[i[s]] - y[j[s]]) ** 2).sum(axis=1)) <= radius
    return near


def _components(near: np.ndarray) -> np.ndarray:
    """First position of each row's component of a symmetric relation that holds for each row itself."""
    comp = np.arange(len(near))
    open_ = near.sum(axis=1) > 1
    for s in np.flatnonzero(open_):
        if not open_[s]:
            continue
        open_[s] = False
        front = np.array([s])
        while len(front):
            new = near[front].any(axis=0) & open_
            open_[new] = False
            front = np.flatnonzero(new)
            comp[front] = s
    return comp


def _local(ids: np.ndarray, x: np.ndarray, radius: float):
    """comp, ball (as ids), reach of the ball at its centre (else -1) and distance from the component's mean, for the
    items of one chunk in order of id."""
    d2, error = _squares(x, x)
    comp = _components(_within(x, x, d2, error, radius))
    ball, reach = np.arange(len(x)), np.zeros(len(x))
    off = np.zeros(len(x))
    inside = d2 <= radius * radius / 4
    size = np.bincount(comp, minlength=len(x))
    order = np.argsort(comp, kind="stable")
    start = np.r_[0, np.cumsum(size)]
    for c in np.flatnonzero(size > 1):
        left = order[start[c] : start[c + 1]]
        off[left] = np.sqrt(((x[left] - x[left].mean(axis=0)) ** 2).sum(axis=1))
        while len(left):
            lead = left[0]
            mine = inside[lead, left]
            mine[0] = True
            took = left[mine]
            ball[took], reach[took] = lead, -1.0
            reach[lead] = np.sqrt(d2[lead, took].max() + error) if len(took) > 1 else 0.0
            left = left[~mine]
    return ids[comp], ids[ball], reach, off


def _chunks(batches, radius: float):
    """Rows sorted by cell, chunk and id to MEMBER rows. Runs of one row pass; longer ones go through _local."""
    keys = [*CELL, "chunk"]
    rest: pa.Table | None = None

    def work(t: pa.Table, cuts: np.ndarray):
        t = t.combine_chunks()
        ids = t["id"].to_numpy()
        comp, ball, reach, off = ids.copy(), ids.copy(), np.zeros(len(ids)), np.zeros(len(ids))
        lists = t["features"].chunk(0) if t.num_rows else None
        flat, at = (lists.values.to_numpy(), lists.offsets.to_numpy()) if lists is not None else (None, None)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 1:
                x = flat[at[lo] : at[hi]].reshape(hi - lo, -1)
                comp[lo:hi], ball[lo:hi], reach[lo:hi], off[lo:hi] = _local(ids[lo:hi], x, radius)
        out = t.select([*CELL, "g", "chunks", "id"]).append_column("comp", pa.array(comp)).append_column("ball", pa.array(ball))
        return out.append_column("reach", pa.array(reach)).append_column("off", pa.array(off)).append_column("features", t["features"])

    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None and rest.num_rows:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        key = np.column_stack([t[k].to_numpy() for k in keys])
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1]
        rest = t.slice(int(cuts[-1]))
        if len(cuts) > 1:
            yield from work(t.slice(0, int(cuts[-1])), cuts).to_batches()
    if rest is not None and rest.num_rows:
        yield from work(rest, np.array([0, rest.num_rows])).to_batches()


def _forest(pairs, size: int) -> list[int]:
    """Positions of the pairs that a spanning forest needs."""
    up = list(range(size))

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    keep = []
    for at, (a, b) in enumerate(pairs):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            keep.append(at)
    return keep


def _link_tiles(batches, radius: float):
    """Rows (a, b, a_ball, b_ball) of two joined blocks of balls: without balls, components linked by alike centres, as
    many as a spanning forest needs; with balls, components that are not linked here, though members may be alike."""
    for t in batches:
        out = []
        for r in t.itertuples(index=False):
            a, b, ca, cb, ra, rb = (np.asarray(v) for v in (r.a_ids, r.b_ids, r.a_comp, r.b_comp, r.a_r, r.b_r))
            x, y = np.asarray(r.a_x, float).reshape(len(a), -1), np.asarray(r.b_x, float).reshape(len(b), -1)
            d2, error = _squares(x, y)
            near = d2 <= (radius + ra[:, None] + rb[None, :]) ** 2 + error
            near &= ca[:, None] != cb[None, :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            alike = _within(x, y, d2, error, radius)[i, j]
            names, at = np.unique(np.r_[ca[i], cb[j]], return_inverse=True)
            p, q = at[: len(i)], at[len(i) :]
            links = np.unique(np.column_stack([p[alike], q[alike]]), axis=0)
            keep = links[_forest(links.tolist(), len(names))]
            out.append(np.column_stack([names[keep], np.full((len(keep), 2), -1)]))
            root = np.arange(len(names))
            for u, v in keep.tolist():
                root[root == root[v]] = root[u]
            open_ = ~alike & (root[p] != root[q]) & (ra[i] + rb[j] > 0)
            out.append(np.column_stack([ca[i[open_]], cb[j[open_]], a[i[open_]], b[j[open_]]]))
        got = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        yield pd.DataFrame(got.astype(np.int64), columns=["a", "b", "a_ball", "b_ball"])


def _member_tiles(batches, radius: float):
    """Whether any member of one ball is alike to any of the other, block against block."""
    for t in batches:
        hit = []
        for r in t.itertuples(index=False):
            x, y = np.asarray(r.a_x, float).reshape(r.a_n, -1), np.asarray(r.b_x, float).reshape(r.b_n, -1)
            hit.append(bool(_within(x, y, *_squares(x, y), radius).any()))
        yield t.loc[hit, ["a", "b"]]


class Alike:
    """The alike relation of usable items: components within chunks of cells, and links between them.

    usable: (dataset_id, id, features) without repeated ids. sample: rows to choose the grid's features by, if others
    than usable's are cheaper to read. members: one row per item with cell, comp (smallest id of its component in the
    chunk), ball (id of its ball's centre) and off (distance from the component's mean).
    """

    def __init__(self, usable: DataFrame, radius: float = 1.0, least: int = 5, sample: DataFrame | None = None):
        self.radius, self.least = radius, least
        width = radius * (least - 1)
        grid = materialize(axes(usable if sample is None else sample, width))
        items = materialize(with_cells(usable, grid, width))
        self.counts = items.groupBy(*CELL).agg(F.count("*").alias("n"))
        total = items.count()
        crowded = self.counts.where(F.col("n") > CHUNK).select(*CELL, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        if total // CHUNK <= 200_000:  # no more crowded cells than that
            crowded = F.broadcast(crowded)
        each = items.join(crowded, CELL, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        each = each.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks").cast("bigint")))
        parts = max(8, min(4096, -(-total // ROWS_PER_TASK)))
        ordered = each.repartition(parts, *CELL, "chunk").sortWithinPartitions(*CELL, "chunk", "id")
        ordered = ordered.select(*CELL, "g", "chunks", "chunk", "id", "features")
        self.members = materialize(ordered.mapInArrow(lambda t: _chunks(t, radius), MEMBER))
        release(items)
        self.counts = self.members.groupBy(*CELL, "g").agg(F.count("*").alias("n"))
        self.grid = grid

    def cell_pairs(self) -> DataFrame:
        """(a_*, b_*): pairs of touching dense cells whose boxes are within the radius, each once, and each dense cell
        of several chunks with itself."""
        bound = lambda f, s, p: F.expr(f"struct({', '.join(f'{f}(get(features, get(axes, {k})) {s} reach) AS {p}{k}' for k in range(AXES))})").alias(p)
        centres = self.members.where("id = ball").join(self.grid.select("dataset_id", "axes"), "dataset_id")
        boxes = centres.groupBy(*CELL).agg(bound("min", "-", "lo"), bound("max", "+", "hi"), F.max("chunks").alias("chunks"))
        cells = materialize(boxes.join(self.counts, CELL).select(*CELL, "g", "n", "chunks", "lo.*", "hi.*"))
        both = materialize(touching(cells, ["n", *(f"{s}{k}" for s in ("lo", "hi") for k in range(AXES))]))
        part = lambda p, q: both.selectExpr(*(f"{p}_{c} AS {c}" for c in CELL), f"{q}_n AS n")
        around = cells.select(*CELL, "n").unionByName(part("a", "b")).unionByName(part("b", "a")).groupBy(*CELL).agg(F.sum("n").alias("n"))
        dense = materialize(around.where(F.col("n") >= self.least).select(*CELL))
        near = both.where(f"{gap('a_lo{k}', 'a_hi{k}', 'b_lo{k}', 'b_hi{k}')} <= {self.radius**2 * (1 + 1e-9)}D")
        for p in "ab":
            near = near.join(dense.selectExpr(*named(p, CELL)), [f"{p}_{c}" for c in CELL], "left_semi")
        names = [f"{p}_{c}" for p in "ab" for c in CELL]
        own = cells.where("chunks > 1").join(dense, CELL, "left_semi").selectExpr(*named("a", CELL), *named("b", CELL))
        return near.select(*names).unionByName(own)

    def _link(self) -> tuple[DataFrame, DataFrame]:
        radius = self.radius
        pairs = materialize(self.cell_pairs())
        cells = pairs.selectExpr(*(f"a_{c} AS {c}" for c in CELL)).union(pairs.select(*(f"b_{c}" for c in CELL))).distinct()
        centres = self.members.where("id = ball").join(cells, CELL, "left_semi")
        many = centres.groupBy(*CELL).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
        blocks = centres.join(many, CELL, "left").withColumn("block", F.pmod(F.xxhash64("ball"), F.coalesce("blocks", F.lit(1))))
        packed = F.collect_list(F.struct("ball", "comp", "reach", "features"))
        blocks = blocks.groupBy(*CELL, "block").agg(packed.alias("p")).select(
            *CELL, "block", F.col("p.ball").alias("ids"), F.col("p.comp").alias("comp"), F.col("p.reach").alias("r"), F.flatten("p.features").alias("x")
        )
        blocks = materialize(blocks)
        side = lambda p: blocks.selectExpr(*named(p, blocks.columns))
        tiles = pairs.join(side("a"), [f"a_{c}" for c in CELL]).join(side("b"), [f"b_{c}" for c in CELL])
        tiles = tiles.where(f"NOT ({' AND '.join(f'a_{c} = b_{c}' for c in CELL)}) OR a_block <= b_block")
        tiles = tiles.select(*(f"{p}_{c}" for p in "ab" for c in ("ids", "comp", "r", "x")))
        found = materialize(tiles.mapInPandas(lambda t: _link_tiles(t, radius), "a bigint, b bigint, a_ball bigint, b_ball bigint"))
        return found.where("a_ball < 0").select("a", "b"), found.where("a_ball >= 0")

    def _near(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs of balls of which a member of one is alike to a member of the other."""
        want = pairs.select(F.col("a_ball").alias("ball")).union(pairs.select("b_ball")).distinct()
        m = self.members.join(want, "ball", "left_semi").select("ball", "id", "features")
        blocks = materialize(m.groupBy("ball").agg(F.count("*").cast("int").alias("n"), F.flatten(F.collect_list("features")).alias("x")))
        side = lambda p: blocks.select(F.col("ball").alias(f"{p}_ball"), F.col("n").alias(f"{p}_n"), F.col("x").alias(f"{p}_x"))
        radius = self.radius
        tiles = pairs.join(side("a"), "a_ball").join(side("b"), "b_ball").select("a", "b", "a_n", "a_x", "b_n", "b_x")
        return tiles.mapInPandas(lambda t: _member_tiles(t, radius), "a bigint, b bigint").distinct()

    def labels(self) -> DataFrame:
        """(comp, label) of the components that are linked: the smallest id of all that alike pairs connect."""
        links, open_ = self._link()
        first = materialize(min_labels(links))
        a = first.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = first.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        la, lb = F.coalesce("la", "a"), F.coalesce("lb", "b")
        still = open_.join(a, "a", "left").join(b, "b", "left").where(la != lb).select(la.alias("a"), lb.alias("b"), "a_ball", "b_ball")
        still = materialize(still.distinct())
        if not still.limit(1).count():
            return first.select(F.col("node").alias("comp"), "label")
        second = materialize(min_labels(self._near(still)))
        both = first.join(second.select(F.col("node").alias("label"), F.col("label").alias("last")), "label", "left")
        one = both.select(F.col("node").alias("comp"), F.coalesce("last", "label").alias("label"))
        new = second.join(first, "node", "left_anti").select(F.col("node").alias("comp"), "label")
        return one.unionByName(new)


def groups(alike: Alike) -> DataFrame:
    """(dataset_id, group_id, id, cell coordinates, off) for each member of a group of at least alike.least items.

    Items that repeat a vector are each a member. An empty input gives an empty result. Sizes are summed over
    components, of which a chunk of a hot cell is one row.
    """
    comps = alike.members.groupBy("comp").agg(F.count("*").alias("n"))
    named = materialize(comps.join(alike.labels(), "comp", "left").select("comp", "n", F.coalesce("label", "comp").alias("group_id")))
    size = named.groupBy("group_id").agg(F.sum("n").alias("size")).where(F.col("size") >= alike.least)
    of = named.join(size, "group_id", "left_semi").select("comp", "group_id")
    return alike.members.join(of, "comp").select("dataset_id", "group_id", "id", *COORDS, "off")


def describe(members: DataFrame, attributes: DataFrame, typical: int = 3) -> DataFrame:
    """One row per group: size, its most typical members and their categories.

    Typical are the members of the group's densest cell (of equals that of the lowest coordinates) that are nearest to
    the mean of the group's part there; equals by id. attributes: standing (id, attr_name, category) rows; categories
    are listed as "name=value", sorted, without the absent ones.
    """
    cell = F.struct(*(F.col(c).alias(c) for c in COORDS))
    cells = members.groupBy("dataset_id", "group_id", *COORDS).agg(F.count("*").alias("n"))
    best = cells.groupBy("dataset_id", "group_id").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), cell.alias("cell"))).alias("m"))
    best = best.select("dataset_id", "group_id", "size", *(F.col(f"m.cell.{c}").alias(c) for c in COORDS))
    inner = members.join(best.select("group_id", *COORDS), ["group_id", *COORDS])
    salted = inner.select("group_id", "id", "off", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    order = ["off", "id"]
    few = salted.withColumn("k", F.row_number().over(Window.partitionBy("group_id", "salt").orderBy(*order))).where(F.col("k") <= typical)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).where(F.col("k") <= typical)
    few = materialize(few.select("group_id", "id", "k"))
    first = few.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("typical_ids"))
    kinds = few.join(attributes, "id").where("category <> ''")
    kinds = kinds.groupBy("group_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "attr_name", "category"))).alias("categories"))
    out = best.join(first, "group_id").join(kinds, "group_id", "left")
    return out.select("dataset_id", "group_id", "size", "typical_ids", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))
