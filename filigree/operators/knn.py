"""k nearest neighbours of all items, and their graph.

Exact: items are packed in blocks and every pair of blocks is a tile, multiplied by BLAS; a tile gives the best k of
its rows both ways, which a ranked merge cuts to k. Approximate: items go to the nearest of a bounded number of
centres, and each item is compared with the lists of its nearest few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import materialize

BLOCK = 2048
PAIR = "src bigint, dst bigint, distance double"


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.maximum(d, 0, out=d)


def _best(ids_a, x, ids_b, y, d2, k: int) -> pd.DataFrame:
    """k nearest rows of b for each row of a; candidates a little beyond k are recomputed by differences."""
    d2 = np.where(ids_a[:, None] == ids_b[None, :], np.inf, d2)
    limit = np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] > k else np.full(len(d2), np.inf)
    scale = 1e-12 * (1 + float((x * x).sum(1).max(initial=0)) + float((y * y).sum(1).max(initial=0)))
    i, j = np.nonzero((d2 <= (limit * (1 + 1e-9) + scale)[:, None]) & np.isfinite(d2))
    d = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
    order = np.lexsort((ids_b[j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return pd.DataFrame({"src": ids_a[i[keep]], "dst": ids_b[j[keep]], "distance": d[keep]})


def _tiles(batches, k: int, both: bool):
    for t in batches:
        for r in t.itertuples(index=False):
            a, b = np.asarray(r.a_ids), np.asarray(r.b_ids)
            x, y = np.asarray(r.a_x).reshape(len(a), -1), np.asarray(r.b_x).reshape(len(b), -1)
            d2 = _distances(x, y)
            yield _best(a, x, b, y, d2, k)
            if both and r.a != r.b:
                yield _best(b, y, a, x, d2.T, k)


def _blocks(rows: DataFrame, key: list[str]) -> DataFrame:
    packed = rows.groupBy(*key).agg(F.collect_list(F.struct("id", "x")).alias("p"))
    return packed.select(*key, F.col("p.id").alias("ids"), F.flatten("p.x").alias("x"))


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def tiles(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair a <= b of blocks of items (id, x): ids and vectors of both, flat. Rows with a null id or vector are
    left out. Tiles are spread evenly over tasks."""
    sound = items.where("id IS NOT NULL AND x IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x"))
    parts = max(1, -(-sound.count() // block))
    blocks = materialize(_blocks(sound.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts))), ["block"]))
    side = lambda p: blocks.select(F.col("block").alias(p), F.col("ids").alias(f"{p}_ids"), F.col("x").alias(f"{p}_x"))
    grid = items.sparkSession.range(parts * parts).select(F.floor(F.col("id") / parts).alias("a"), (F.col("id") % parts).alias("b")).where("a <= b")
    joined = grid.join(side("a"), "a").join(side("b"), "b").repartition(max(1, min(parts * (parts + 1) // 2, 4096)), "a", "b")
    return joined.select("a", "b", "a_ids", "a_x", "b_ids", "b_x")


def knn(items: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance, rank): the k nearest other items of each item (id, x), ties by id. Items with a null id
    or vector take no part; copies are neighbours at distance 0."""
    return _top(tiles(items).mapInPandas(lambda t: _tiles(t, k, True), PAIR), k)


def knn_approximate(items: DataFrame, k: int, lists: int = 64, probes: int | None = None, recall: float = 0.9, sample: int = 200, seed: int = 0) -> DataFrame:
    """knn() with a loss: items in the same or near lists only.

    lists: centres, at most 4096, taken by hash from the items (a bounded sample); every item is indexed. probes: how
    many lists an item is compared with; equal to lists it is exact. If it is None, the true neighbours of `sample`
    items are found by brute force, and probes is the least number that reaches at least `recall` of them (with a
    margin of 0.03). Lists are cut in blocks of BLOCK items.
    """
    if not 1 <= (probes or 1) <= lists <= 4096:
        raise ValueError("1 <= probes <= lists <= 4096")
    sound = items.where("id IS NOT NULL AND x IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x"))
    chosen = sound.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(lists).collect()
    if not chosen:
        return sound.sparkSession.createDataFrame([], PAIR + ", rank int")
    centres = np.array([r["x"] for r in chosen])

    def homes(batches):
        for b in batches:
            if len(b):
                b["home"] = _distances(np.stack(b["x"].to_numpy()), centres).argmin(axis=1)
                yield b

    placed = materialize(sound.mapInPandas(homes, "id bigint, x array<double>, home int"))
    side = lambda t, p: _blocks(t, ["list", "block"]).select("list", F.col("block").alias(p), F.col("ids").alias(f"{p}_ids"), F.col("x").alias(f"{p}_x"))
    if probes is None:
        asked = materialize(placed.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(sample).select("id", "x"))
        parts = max(1, -(-placed.count() // BLOCK))
        all_ = placed.select(F.lit(0).alias("list"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block"), "id", "x")
        few = asked.select(F.lit(0).alias("list"), F.lit(0).alias("block"), "id", "x")
        tiles = side(few, "a").join(side(all_, "b"), "list").select("a", "b", "a_ids", "a_x", "b_ids", "b_x")
        true = _top(tiles.mapInPandas(lambda t: _tiles(t, k, False), PAIR), k)
        rows = true.join(placed.select(F.col("id").alias("dst"), "home"), "dst").join(asked.withColumnRenamed("id", "src"), "src").select("x", "home").toPandas()  # sample * k rows
        d = _distances(np.stack(rows["x"].to_numpy()), centres) if len(rows) else np.zeros((0, len(centres)))
        place = (d < d[np.arange(len(d)), rows["home"].to_numpy(int)][:, None]).sum(axis=1) + 1
        probes = int(np.quantile(place, min(1.0, recall + 0.03), method="higher")) if len(place) else 1
    probes = min(probes, len(centres))

    def near(batches):
        for b in batches:
            if len(b):
                d = _distances(np.stack(b["x"].to_numpy()), centres)
                best = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.tile(np.arange(len(centres)), (len(b), 1))
                b["near"] = list(best.astype(np.int32))
                yield b[["id", "x", "near"]]

    sizes = placed.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    data = placed.join(sizes, "home").select(F.col("home").alias("list"), F.pmod(F.xxhash64("id"), F.col("n")).alias("block"), "id", "x")
    asks = placed.select("id", "x").mapInPandas(near, "id bigint, x array<double>, near array<int>").select(F.explode("near").alias("list"), "id", "x")
    many = asks.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    asks = asks.join(many, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
    tiles = side(asks, "a").join(side(data, "b"), "list").select("a", "b", "a_ids", "a_x", "b_ids", "b_x")
    return _top(tiles.mapInPandas(lambda t: _tiles(t, k, False), PAIR), k)


def knn_edges(directed: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(src, dst, weight), src < dst: 2 if both are among each other's neighbours, else 1. Neighbours beyond
    max_distance are dropped after ranking."""
    kept = directed if max_distance is None else directed.where(F.col("distance") <= max_distance)
    return kept.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
