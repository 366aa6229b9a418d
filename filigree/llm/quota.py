"""Samples whose categories match target shares: integer quotas by min-cost flow, then random draws.

Per request, sample_size units leave the source. A category's arc takes its goal: its target, where all targets are at
or above the categories' floors. Where floors are above targets, they come first, and what they take beyond is given up
by the other categories in proportion to their room above their own floors (goals), so the sample keeps its size; only
floors that together exceed sample_size make it larger. From a category, units go on to each class of the other
attributes (arc: how many items of the data set have both) and from there to the sink (arc: that class's share of the
request, so that the sample keeps the make-up of what is available; a unit beyond it costs 1). What a category wants but
does not hold, its slack arc to the sink takes at a higher cost than any other way: its shortfall. As costs take only
these values, the cheapest flow comes from maximum flows on end, each in the residual network of the one before.

The flow sees counts only, at most CLASSES classes for each category: the commonest, and one for all others. Items are
counted with map-side combining, requests are solved in PARTS tasks, and the draw ranks each cell's items by a hash, in
salted parts (cover.top).
"""

from __future__ import annotations

import random
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.llm.cover import SPLIT, top
from filigree.llm.items import category, standing

OPEN = 1 << 60
CLASSES = 256
PARTS = 64
REST = "*"


class _Flow:
    """Maximum flows by blocking flows; arcs may be added between runs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def arc(self, a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        while True:
            depth = {s: 0}
            queue = deque([s])
            while queue:
                v = queue.popleft()
                for e in self.out[v]:
                    if self.cap[e] and self.to[e] not in depth:
                        depth[self.to[e]] = depth[v] + 1
                        queue.append(self.to[e])
            if t not in depth:
                return
            at = [0] * len(self.out)
            path: list[int] = []
            v = s
            while True:
                if v == t:
                    least = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= least
                        self.cap[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if not self.cap[e])
                    v = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while at[v] < len(self.out[v]):
                    e = self.out[v][at[v]]
                    if self.cap[e] and depth.get(self.to[e]) == depth[v] + 1:
                        break
                    at[v] += 1
                else:
                    if v == s:
                        break
                    v = self.to[path.pop() ^ 1]
                    at[v] += 1
                    continue
                path.append(e)
                v = self.to[e]


def _margins(total: int, sizes: list[int]) -> list[int]:
    """total in proportion to sizes, by largest remainders."""
    whole = sum(sizes)
    if not whole:
        return [0] * len(sizes)
    base = [total * n // whole for n in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (-(total * sizes[i] % whole), i))
    for i in order[: total - sum(base)]:
        base[i] += 1
    return base


def goals(target: dict[str, int], floor: dict[str, int]) -> dict[str, int]:
    """How many each category should give: at least its floor, the sum that of the targets if floors allow it."""
    kinds = sorted(target)
    room = [max(0, target[c] - floor[c]) for c in kinds]
    over = sum(max(0, floor[c] - target[c]) for c in kinds)
    less = _margins(over, room) if over <= sum(room) else room
    return {c: max(target[c], floor[c]) - n for c, n in zip(kinds, less)}


def solve(
    want: dict[str, int], have: dict[tuple[str, str], int], seed: int = 0, goal: dict[str, int] | None = None
) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """Quota of each cell (category, other class), and each category's shortfall: what it wants beyond what it holds.
    goal: how many to draw of each category, if other than it wants."""
    goal = want if goal is None else goal
    rng = random.Random(seed)
    kinds = sorted(want)
    others = sorted({o for (c, o), n in have.items() if c in want})
    cells = [(c, o) for (c, o), n in sorted(have.items()) if c in want and n > 0]
    rng.shuffle(cells)
    sizes = [sum(n for (c, o), n in have.items() if o == x and c in want) for x in others]
    room = {c: sum(n for (k, _), n in have.items() if k == c) for c in kinds}
    margins = _margins(sum(min(goal[c], room[c]) for c in kinds), sizes)
    s, t = len(kinds) + len(others), len(kinds) + len(others) + 1
    flow = _Flow(t + 1)
    node = {c: i for i, c in enumerate(kinds)} | {("o", o): len(kinds) + i for i, o in enumerate(others)}
    for c in kinds:
        flow.arc(s, node[c], goal[c])
    arcs = {(c, o): flow.arc(node[c], node["o", o], have[c, o]) for c, o in cells}
    for o, m in zip(others, margins):
        flow.arc(node["o", o], t, m)
    flow.run(s, t)
    for o in others:
        flow.arc(node["o", o], t, OPEN)
    flow.run(s, t)
    quota = {k: flow.cap[e ^ 1] for k, e in arcs.items() if flow.cap[e ^ 1]}
    # what is wanted beyond the goal is not drawn, but shows what the category lacks
    for c in kinds:
        flow.arc(s, node[c], max(0, want[c] - goal[c]))
    flow.run(s, t)
    slack = {c: flow.arc(node[c], t, OPEN) for c in kinds}
    flow.run(s, t)
    return quota, {c: flow.cap[e ^ 1] for c, e in slack.items()}


def holdings(items: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, dataset_id, attr_name, kind, other): each standing attribute of each standing item that has a data set;
    kind is its category, other the item's remaining attributes as one class. Null or blank values have no kind."""
    item = standing(items.select("id", "dataset_id", "loaded_at"), ["id"]).where("dataset_id IS NOT NULL").select("id", "dataset_id")
    last = standing(attributes.select("id", "attr_name", "attr_value", "loaded_at"), ["id", "attr_name"])
    each = last.select("id", "attr_name", F.coalesce(category(F.col("attr_value")), F.lit("")).alias("kind"))
    each = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("attr_name", "kind"))).alias("all")).join(item, "id")
    one = each.select("id", "dataset_id", "all", F.explode("all").alias("one"))
    other = F.filter("all", lambda x: x["attr_name"] != F.col("one.attr_name"))
    other = F.concat_ws("\x1f", F.transform(other, lambda x: F.concat_ws("=", x["attr_name"], x["kind"])))
    rows = one.where("one.kind <> ''").select("id", "dataset_id", "one.attr_name", "one.kind", other.alias("other"))
    # the commonest classes keep their name, all others are one class
    classes = rows.groupBy("dataset_id", "attr_name", "other").agg(F.count("*").alias("n"))
    order = Window.partitionBy("dataset_id", "attr_name").orderBy(F.col("n").desc(), "other")
    common = classes.withColumn("r", F.row_number().over(order)).where(F.col("r") < CLASSES).select("dataset_id", "attr_name", "other", F.lit(True).alias("_own"))
    named = rows.join(common, ["dataset_id", "attr_name", "other"], "left")
    return named.select("id", "dataset_id", "attr_name", "kind", F.when(F.col("_own"), F.col("other")).otherwise(F.lit(REST)).alias("other"))


def wanted(targets: DataFrame) -> DataFrame:
    """Each target row with kind, floor (min_rows), target (target_share * sample_size, rounded) and want, the greater
    of both. Nulls and negative numbers ask for nothing."""
    share = F.greatest(F.round(F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0.0))).cast("bigint"), F.lit(0))
    floor = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), F.lit(0))
    rows = targets.where("request_id IS NOT NULL AND category IS NOT NULL")
    cols = ["request_id", "dataset_id", "attr_name", "category", category(F.col("category")).alias("kind")]
    return rows.select(*cols, floor.alias("floor"), share.alias("target"), F.greatest(floor, share).alias("want"))


def quotas(want: DataFrame, held: DataFrame, seed: int = 0) -> DataFrame:
    """(request_id, category, kind, other, want, goal, available, quota, shortfall, deviation).

    For each row of want one report row with other null: quota is the total drawn, deviation that less the target; then
    a row for each cell drawn from. Rows of a request that name one kind twice share its items: their targets, floors
    and wants are added in the flow, and each has the goal, quota and shortfall of both.
    """
    counts = held.groupBy("dataset_id", "attr_name", "kind", "other").agg(F.count("*").alias("n"))
    asks = want.select(F.col("request_id").alias("rid"), "dataset_id", "attr_name", "kind").distinct()
    have = counts.join(asks, ["dataset_id", "attr_name", "kind"]).select("rid", "kind", "other", "n")
    names = ["want", "goal", "available", "quota", "shortfall", "deviation"]

    def one(w: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        w = w.sort_values(["category", "want"])
        h = h if len(w) else h.iloc[:0]
        cells = {(k, o): int(n) for k, o, n in zip(h["kind"], h["other"], h["n"])}
        total = lambda c: {k: int(n) for k, n in w.groupby("kind")[c].sum().items()}
        goal, target = goals(total("target"), total("floor")), total("target")
        quota, short = solve(total("want"), cells, seed, goal)
        room: dict[str, int] = {}
        drawn: dict[str, int] = {}
        for (k, _), n in cells.items():
            room[k] = room.get(k, 0) + n
        for (k, _), n in quota.items():
            drawn[k] = drawn.get(k, 0) + n
        rows = [
            (r.request_id, r.category, r.kind, None, r.want, goal[r.kind], room.get(r.kind, 0), drawn.get(r.kind, 0), short[r.kind], drawn.get(r.kind, 0) - target[r.kind])
            for r in w.itertuples()
        ]
        called = dict(zip(w["kind"], w["category"]))
        rid = w["request_id"].iloc[0] if len(w) else None
        rows += [(rid, called[k], k, o, None, None, cells[k, o], n, None, None) for (k, o), n in quota.items()]
        return pd.DataFrame(rows, columns=["request_id", "category", "kind", "other", *names]).astype(dict.fromkeys(names, "Int64"))

    schema = "request_id bigint, category string, kind string, other string, " + ", ".join(f"{c} bigint" for c in names)
    # a fixed number of partitions: by size alone they would be merged to one, though the work goes with requests
    w = want.select("request_id", "category", "kind", "floor", "target", "want").repartition(PARTS, "request_id").groupBy("request_id")
    return w.cogroup(have.repartition(PARTS, "rid").groupBy("rid")).applyInPandas(one, schema)


def short_of(report: DataFrame) -> DataFrame:
    """(request_id, category) of the categories with flow on their slack arc that hold fewer items than wanted."""
    return report.where("other IS NULL AND shortfall > 0 AND available < want").select("request_id", "category").distinct()


def draw(report: DataFrame, want: DataFrame, held: DataFrame, seed: int = 0) -> DataFrame:
    """(request_id, category, id): the sample, each cell's quota drawn by a hash of request and id."""
    where = want.select("request_id", "dataset_id", "attr_name").distinct()
    cells = report.where("other IS NOT NULL").join(where, "request_id")
    cells = cells.select("dataset_id", "attr_name", "kind", "other", "request_id", "category", "quota", F.ceil(F.col("available") / SPLIT).alias("_salts"))
    rows = held.join(cells, ["dataset_id", "attr_name", "kind", "other"])
    order = [F.md5(F.concat_ws("-", "request_id", "id", F.lit(str(seed)))), F.col("id")]
    return top(rows, ["request_id", "kind", "other"], order, "quota", "place", F.col("_salts")).select("request_id", "category", "id")
