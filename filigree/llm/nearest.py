"""The k nearest vectors of every query vector: block matrix join with int8 tiles.

Vectors of a data set are sorted by a coarse cell and cut into blocks of at most BLOCK rows, so that a group of similar
vectors has blocks of its own. A block has a centre, each row as int8 steps from it (a coarse byte and a fine one, of a
FINE-th of the step) with the norm of what rounding took away, and the distance within which a row has k others of its
block. A tile joins a block of queries with a block of vectors of the same data set: the products of the bytes give each
distance up to the two rounding norms, so a pair survives only if its lower bound is within the k-th smallest upper
bound of its query; survivors are recomputed in float64 and merged into the best k of each row. The result is exact.

Tiles are made between stacks of STACK blocks, so that a data set's rows are sent once per stack of queries, not once
per block.

The product runs on float32 copies of the bytes: sums stay below 2**24, so it is exact, and it uses the BLAS that NumPy
has for floats only. Blocks are at most BLOCK rows, so a hot data set becomes more tiles, not larger ones; its block
pairs are looked through in parts of SPREAD query blocks. Block pairs, and rows within a tile, whose centres and radii
leave no room for a neighbour are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import materialize

BLOCK = 1024
PURE = 256
STACK = 8
FINE = 254
SPREAD = 64
LIGHT = "block bigint, centre binary, radius double, reach double"
HEAVY = "block bigint, n int, dims int, ids binary, x binary, near binary, centre binary, scale double, radius double"
STACK_SCHEMA = f"dataset_id bigint, stack bigint, light array<struct<{LIGHT.replace(' ', ': ')}>>, heavy array<struct<{HEAVY.replace(' ', ': ')}>>".replace(",: ", ", ")


def _steps(off: np.ndarray, scale: float) -> np.ndarray:
    """Rows as bytes: the coarse steps of each, then the fine ones."""
    coarse = np.rint(off / scale)
    fine = np.rint((off - coarse * scale) * (FINE / scale))
    return np.hstack([coarse, fine]).astype(np.int8)


def _steps_value(q: np.ndarray, scale: float) -> np.ndarray:
    d = q.shape[1] // 2
    return (q[:, :d] + q[:, d:] / FINE) * scale


def _pack(batches, k: int):
    """Rows in sort order to stacks of blocks: long runs of one cell by themselves, shorter ones together, never two
    data sets in a stack."""
    part, seq = None, 0
    mixed: list[pd.DataFrame] = []
    stack: list[tuple[int, dict]] = []
    kept = None

    def block(rows: pd.DataFrame):
        nonlocal seq
        x = np.stack(rows["features"].to_numpy()).astype(np.float64)
        centre = x.mean(axis=0)
        off = x - centre
        scale = float(np.abs(off).max()) / 127 or 1.0
        size = (off**2).sum(axis=1)
        near = np.full(len(x), np.inf)
        if len(x) > k:
            d2 = size[:, None] + size[None, :] - 2 * (off @ off.T)
            np.fill_diagonal(d2, np.inf)
            near = np.sqrt(np.maximum(np.partition(d2, k - 1, axis=1)[:, k - 1], 0) + 1e-11 * (1 + size.max())) * (1 + 1e-9)
        seq += 1
        ids, radius = rows["id"].to_numpy(np.int64), float(np.sqrt(size.max()))
        return int(rows["dataset_id"].iloc[0]), {
            "block": (part << 32) + seq, "n": len(x), "dims": x.shape[1], "ids": ids.tobytes(), "x": x.tobytes(), "near": near.tobytes(),
            "centre": centre.tobytes(), "scale": scale, "radius": radius, "reach": float(near.max()),
        }

    def stacked(blocks, last: bool):
        """Whole stacks of the blocks so far."""
        rows = []

        def put():
            light = [{c: b[c] for c in ("block", "centre", "radius", "reach")} for _, b in stack]
            heavy = [{c: v for c, v in b.items() if c != "reach"} for _, b in stack]
            rows.append((stack[0][0], stack[0][1]["block"], light, heavy))
            stack.clear()

        for b in blocks:
            if stack and (len(stack) == STACK or stack[0][0] != b[0]):
                put()
            stack.append(b)
        if last and stack:
            put()
        return pd.DataFrame(rows, columns=["dataset_id", "stack", "light", "heavy"])

    def flush():
        if mixed:
            rows = pd.concat(mixed, ignore_index=True)
            mixed.clear()
            yield block(rows)

    def runs(rows: pd.DataFrame, last: bool):
        """Blocks of the runs that have ended; returns through `kept` what may go on in the next batch."""
        nonlocal kept
        ds, cell = rows["dataset_id"].to_numpy(), rows["cell"].to_numpy()
        ends = np.r_[np.flatnonzero((ds[1:] != ds[:-1]) | (cell[1:] != cell[:-1])) + 1, len(rows)]
        lo = 0
        for hi in ends:
            ended = last or hi < len(rows)
            while hi - lo >= BLOCK:
                yield block(rows.iloc[lo : lo + BLOCK])
                lo += BLOCK
            if not ended:
                break
            if hi - lo >= PURE:
                yield block(rows.iloc[lo:hi])
            elif hi > lo:
                if mixed and (mixed[0]["dataset_id"].iloc[0] != ds[lo] or sum(map(len, mixed)) + hi - lo > BLOCK):
                    yield from flush()
                mixed.append(rows.iloc[lo:hi])
            lo = hi
        kept = rows.iloc[lo:] if lo < len(rows) else None

    for b in batches:
        if len(b):
            part = int(b["part"].iloc[0]) if part is None else part
            out = stacked(runs(b if kept is None else pd.concat([kept, b], ignore_index=True), False), False)
            if len(out):
                yield out
    rest = list(runs(kept.reset_index(drop=True), True)) if kept is not None else []
    out = stacked([*rest, *flush()], True)
    if len(out):
        yield out


def blocks(vectors: DataFrame, parts: int, k: int) -> DataFrame:
    """vectors (dataset_id, id, features) as stacks of blocks.

    Rows are sorted by a coarse cell of all features (twice their root mean square wide), so that a group of similar
    rows is one run and its blocks are compact. Range partitions have the id as last key: a hot data set or cell is
    cut like any other.
    """
    square = F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v) / F.size("features")
    width = vectors.groupBy("dataset_id").agg((F.sqrt(F.avg(square)) * 2).alias("width"))
    cell = F.xxhash64(F.transform("features", lambda v: F.floor(v / F.col("width"))))
    keys = ["dataset_id", "cell", "id"]
    ordered = vectors.join(width, "dataset_id").withColumn("cell", F.when(F.col("width") > 0, cell).otherwise(F.lit(0)))
    ordered = ordered.select("dataset_id", "cell", "id", "features").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn("part", F.spark_partition_id()).mapInPandas(lambda t: _pack(t, k), STACK_SCHEMA))


def _unpack(r):
    """ids, vectors, steps, norms of what rounding took away, centre and step of a block. Steps are made here: vectors
    travel for the exact distances, and steps beside them would only make blocks larger."""
    n, dims = r["n"], r["dims"]
    get = lambda c, t: np.frombuffer(r[c], dtype=t)
    x, centre, scale = get("x", np.float64).reshape(n, dims), get("centre", np.float64), r["scale"]
    off = x - centre
    q = _steps(off, scale)
    return get("ids", np.int64), x, q, np.sqrt(((off - _steps_value(q, scale)) ** 2).sum(axis=1)), centre, scale


def tile(a, b, k: int, reach=np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers in a and b, and distances, of the tile's k nearest rows of b within reach (a number, or one for
    each row) of each row of a, by row, distance and id; or fewer."""
    ids_a, xa, qa, ea, ca, sa = a
    ids_b, xb, qb, eb, cb, sb = b
    reach = np.broadcast_to(np.asarray(reach, float), (len(ids_a),))
    dims = xa.shape[1]
    fa, fb = qa.astype(np.float32), qb.astype(np.float32)
    turned = np.hstack([fb[:, dims:], fb[:, :dims]])
    gap, va, vb = ca - cb, _steps_value(qa, sa), _steps_value(qb, sb)
    mid = (fa @ turned.T).astype(np.float64)  # coarse by fine, both ways
    mid += (fa[:, dims:] @ fb[:, dims:].T) / FINE
    mid /= FINE
    mid += fa[:, :dims] @ fb[:, :dims].T
    mid *= -2 * sa * sb
    mid += (np.einsum("ij,ij->i", va, va) + 2 * (va @ gap) + gap @ gap)[:, None]
    mid += (np.einsum("ij,ij->i", vb, vb) - 2 * (vb @ gap))[None, :]
    np.sqrt(np.maximum(mid, 0, out=mid), out=mid)
    slack = 1e-6 * (1 + np.sqrt(gap @ gap) + 127 * (sa + sb) * np.sqrt(dims))  # of the float64 and root arithmetic
    own, at_a, at_b = np.intersect1d(ids_a, ids_b, return_indices=True)
    mid[at_a, at_b] = np.inf
    limit = reach
    if mid.shape[1] > k:
        high = mid + eb[None, :]
        limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1] + ea + slack)
    mid -= eb[None, :]
    i, j = np.nonzero((mid <= (limit + ea + slack)[:, None]) & (mid < np.inf))
    d = np.empty(len(i))
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        d[s] = np.sqrt(((xa[i[s]] - xb[j[s]]) ** 2).sum(axis=1))
    order = np.lexsort((ids_b[j], d, i))
    i, j, d = i[order], j[order], d[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], d[best]


class _Best:
    """The k best of each row of a block so far: what a heap per row would hold, as sorted arrays."""

    def __init__(self, block, near: np.ndarray, k: int):
        self.block, self.k = block, k
        n = len(block[0])
        self.ids, self.d, self.reach = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf), near.copy()

    def meet(self, other, radius: float) -> None:
        ids, x, q, err, centre, scale = self.block
        low = np.sqrt(((x - other[4]) ** 2).sum(axis=1)) * (1 - 1e-9) - radius * (1 + 1e-9) - 1e-9
        rows = np.flatnonzero(low <= self.reach)
        if not len(rows):
            return
        i, j, d = tile((ids[rows], x[rows], q[rows], err[rows], centre, scale), other, self.k, self.reach[rows])
        new_d, new_i = np.full((len(rows), self.k), np.inf), np.full((len(rows), self.k), np.iinfo(np.int64).max)
        at = np.arange(len(i)) - np.searchsorted(i, i)
        new_d[i, at], new_i[i, at] = d, other[0][j]
        all_d, all_i = np.hstack([self.d[rows], new_d]), np.hstack([self.ids[rows], new_i])
        order = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
        self.d[rows], self.ids[rows] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
        self.reach = np.minimum(self.reach, self.d[:, -1])

    def rows(self) -> pd.DataFrame:
        i, c = np.nonzero(np.isfinite(self.d))
        return pd.DataFrame({"src": self.block[0][i], "dst": self.ids[i, c], "distance": self.d[i, c]})


def _tiles(batches, k: int):
    """The block pairs of two joined stacks, near ones first; each query row's best k of the whole tile go on."""
    for t in batches:
        for r in t.itertuples(index=False):
            a = {x["block"]: _Best(_unpack(x), np.frombuffer(x["near"], np.float64), k) for x in r.a_blocks}
            b = {x["block"]: (_unpack(x), x["radius"]) for x in r.b_blocks}
            used = set()
            for x in sorted(r.todo, key=lambda x: x["low"]):
                a[x["a_block"]].meet(*b[x["b_block"]])
                used.add(x["a_block"])
            for v in sorted(used):
                yield a[v].rows()


def _near_blocks(batches):
    """The pairs of a query block and a block of its data set that may hold neighbours: the least distance that
    centres and radii allow is within the reach of the query block's rows."""
    for t in batches:
        if not len(t):
            continue
        gap = [np.frombuffer(a, np.float64) - np.frombuffer(b, np.float64) for a, b in zip(t["a_centre"], t["b_centre"])]
        d = np.array([np.sqrt(g @ g) for g in gap])
        t["low"] = np.maximum(d - t["a_radius"].to_numpy() - t["b_radius"].to_numpy(), 0) * (1 - 1e-9) - 1e-9
        yield t.loc[t["low"] <= t["a_reach"], ["a_stack", "b_stack", "a_block", "b_block", "low"]]


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, rows: int | None = None) -> DataFrame:
    """(src, dst, distance, rank): the k nearest other vectors of the same data set for each query.

    vectors: (dataset_id, id, features) without repeated ids; queries: some rows of vectors, or None for all. Ties go to the smaller id. Fewer than k others give fewer rows. Empty input gives an empty result.
    rows: how many vectors there are, if known, for the number of sort partitions.
    """
    spark = vectors.sparkSession
    parts = lambda n: max(1, min(4096, -(-n // (8 * BLOCK))))
    data = blocks(vectors, parts(rows if rows is not None else vectors.count()), k)
    asks = data if queries is None else blocks(queries, parts(queries.count()), k)
    light = lambda t, p: t.select("dataset_id", "stack", F.explode("light").alias("l")).select("dataset_id", *(F.col(c).alias(f"{p}_{c.split('.')[-1]}") for c in ("stack", "l.block", "l.centre", "l.radius", "l.reach")))
    a, b = light(asks, "a"), light(data, "b").drop("b_reach")
    # a hot data set's pairs are made in parts of SPREAD query blocks, each with all of its blocks
    many = a.groupBy("dataset_id").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts"))
    a = a.join(many, "dataset_id").withColumn("salt", F.pmod(F.xxhash64("a_block"), F.col("salts").cast("bigint")).cast("int")).drop("salts")
    b = b.join(many, "dataset_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    pairs = a.join(b, ["dataset_id", "salt"]).drop("dataset_id", "salt")
    spread = pairs.repartition(max(8, spark.sparkContext.defaultParallelism))
    todo = spread.mapInPandas(_near_blocks, "a_stack bigint, b_stack bigint, a_block bigint, b_block bigint, low double")
    todo = todo.groupBy("a_stack", "b_stack").agg(F.collect_list(F.struct("a_block", "b_block", "low")).alias("todo"))
    todo = materialize(todo)
    heavy = lambda t, p: t.select(F.col("stack").alias(f"{p}_stack"), F.col("heavy").alias(f"{p}_blocks"))
    # a fixed number of partitions: by size alone they would be merged to a few, though the work goes with tiles
    joined = todo.join(heavy(asks, "a"), "a_stack").repartition(max(8, min(4096, todo.count() // 4)), "b_stack").join(heavy(data, "b"), "b_stack")
    found = joined.select("todo", "a_blocks", "b_blocks").mapInPandas(lambda t: _tiles(t, k), "src bigint, dst bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
