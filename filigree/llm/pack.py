"""Documents into containers of fixed capacity: linear grouping.

Lengths are whole tokens, so all planning runs on the histogram of lengths, which has at most `capacity` rows however
many documents there are; only it comes to the driver. Lengths above capacity / SMALL are large: in descending order
they form GROUPS groups of equal count, and each group is rounded up to its longest. Configurations of these few sizes
(how many of each fill one container) are optimised by column generation with a knapsack over the capacity. Documents
then take the places of their group by rank, and what they really leave free is filled with the small ones, longest
first, each to the container with the least room that is enough (best fit), planned as runs of equal containers.

A document longer than the capacity gives full containers and a rest, which is packed like any other document.
Ranks within a length are counted in salted parts, so a length that very many documents share is no single task.
"""

from __future__ import annotations

import base64
import bisect
import logging
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import materialize

CAPACITY = 4096
SMALL = 8
GROUPS = 64

log = logging.getLogger("filigree")
_encoders: dict[str, object] = {}


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary that the environment provides; any other .tiktoken file may be named instead."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encoder(path: str):
    """Byte-level BPE of a .tiktoken file, built once in each process."""
    if path not in _encoders:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_lengths(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of whole texts, without special tokens; a null text has 0."""

    def count(batches):
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


def _best_configuration(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value: knapsack by number of pieces."""
    best, took = [np.zeros(capacity + 1)], []
    for _ in range(capacity // int(sizes.min())):
        now, pick = best[-1].copy(), np.full(capacity + 1, -1)
        for k in np.flatnonzero(value > 1e-12):
            s = sizes[k]
            better = best[-1][: capacity + 1 - s] + value[k] > now[s:] + 1e-12
            now[s:][better] = (best[-1][: capacity + 1 - s] + value[k])[better]
            pick[s:][better] = k
        best.append(now)
        took.append(pick)
        if (pick < 0).all():
            break
    config, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(took):
        k = pick[room]
        if k >= 0:
            config[k] += 1
            room -= sizes[k]
    return float(value @ config), config


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(configuration, how many containers) that hold the demand: the linear program rounded down, then the rest by
    best fit of the rounded sizes. If the program is left before its optimum, which is logged, all is still packed."""
    s, b = np.array(sizes, np.int64), np.array(demand, np.int64)
    if not len(s):
        return []
    columns = [np.where(np.arange(len(s)) == i, capacity // s[i], 0) for i in range(len(s))]
    cost = np.ones(len(s))
    basis = np.stack(columns, axis=1).astype(float)
    for _ in range(50 * len(s) + 50):
        inverse = np.linalg.inv(basis)
        dual = cost @ inverse
        spare = int(dual.argmin())
        if dual[spare] < -1e-9:
            enter, price = -np.eye(len(s))[spare], 0.0
        else:
            value, config = _best_configuration(dual, s, capacity)
            if value <= 1 + 1e-7:
                break
            enter, price = config.astype(float), 1.0
        x, way = inverse @ b, inverse @ enter
        steps = np.where(way > 1e-9, np.maximum(x, 0) / np.where(way > 1e-9, way, 1), np.inf)
        out = int(steps.argmin())
        if not np.isfinite(steps[out]):
            log.warning("configurations: no finite step; the last basis is used")
            break
        basis[:, out], cost[out] = enter, price
    else:
        log.warning("configurations: not optimal after %d turns; the last basis is used", 50 * len(s) + 50)
    x = np.linalg.solve(basis, b.astype(float))
    left, plan = b.copy(), []
    for j in np.argsort(-x):
        config = basis[:, j].astype(np.int64)
        if cost[j] and (n := int(math.floor(x[j] + 1e-7))) > 0:
            n = min([n, *(left[config > 0] // config[config > 0])])
            if n > 0:
                plan.append((config.tolist(), int(n)))
                left -= n * config
    while left.any():
        config, room = np.zeros(len(s), np.int64), capacity
        for k in np.argsort(-s, kind="stable"):
            n = min(int(left[k]), room // int(s[k]))
            config[k] += n
            room -= n * int(s[k])
        n = int((left[config > 0] // config[config > 0]).min())
        plan.append((config.tolist(), n))
        left -= n * config
    return plan


def plan_large(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[dict[int, int], list[tuple[int, int, int]], int]:
    """first rank of each length in descending order; runs (first rank, count, first container); containers used."""
    lengths = sorted(histogram, reverse=True)
    offset, total = {}, 0
    for n in lengths:
        offset[n] = total
        total += histogram[n]
    if not total:
        return {}, [], 0
    size = -(-total // groups)
    ends = [offset[n] + histogram[n] for n in lengths]
    starts = list(range(0, total, size))
    rounded = [lengths[bisect.bisect_right(ends, at)] for at in starts]
    by_size: dict[int, list[int]] = {}
    for g, r in enumerate(rounded):
        by_size.setdefault(r, []).append(g)
    sizes = sorted(by_size, reverse=True)
    count = lambda g: min(size, total - starts[g])
    plan = configurations(sizes, [sum(map(count, by_size[s])) for s in sizes], capacity)
    at = [starts[by_size[s][0]] for s in sizes]  # groups of one rounded size are neighbours in rank
    runs, base = [], 0
    for config, n in plan:
        for k, many in enumerate(config):
            for _ in range(many):
                runs.append((at[k], n, base))
                at[k] += n
        base += n
    return offset, sorted(runs), base


def plan_small(room: dict[int, int], small: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit in runs: (length, first rank, count, room class, first rank in the class); fresh containers.

    room: containers by what they have free. Fresh containers are class -1.
    """
    stock: dict[int, list[tuple[int, int, int]]] = {}
    for free, n in room.items():
        if free > 0 and n > 0:
            stock.setdefault(free, []).append((free, 0, n))
    keys, runs, fresh = sorted(stock), [], 0

    def put(free: int, run: tuple[int, int, int]) -> None:
        if free <= 0:
            return
        if free not in stock:
            stock[free] = []
            bisect.insort(keys, free)
        stock[free].append(run)

    for s in sorted(small, reverse=True):
        rank, left = 0, small[s]
        while left:
            i = bisect.bisect_left(keys, s)
            if i == len(keys):
                n = -(-left // (capacity // s))
                put(capacity, (-1, fresh, n))
                fresh += n
                continue
            free = keys[i]
            kind, start, n = stock[free].pop()
            if not stock[free]:
                del stock[free]
                keys.pop(i)
            m = min(n, left)
            runs.append((s, rank, m, kind, start))
            if n > m:
                put(free, (kind, start + m, n - m))
            put(free - s, (kind, start, m))
            rank += m
            left -= m
    return runs, fresh


def indexed(rows: DataFrame, key: str, name: str, order: list[str], salts: int) -> DataFrame:
    """rows plus their number from 0 within each key. A key is numbered in salted parts."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    numbered = salted.withColumn(name, F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1)
    return numbered.join(counts, [key, "_salt"]).withColumn(name, (F.col(name) + F.col("_from")).cast("bigint")).drop("_salt", "_from")


def pieces(lengths: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, parts, n): a document no longer than the capacity is one piece; a longer one gives full pieces
    and a rest. Documents without tokens have no piece."""
    parts = F.ceil(F.col("n_tokens") / capacity).cast("int")
    some = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", parts.alias("parts"))
    each = some.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return each.select("doc_id", "part", "parts", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part").cast("bigint") * capacity).cast("int").alias("n"))



def pack(lengths: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """(doc_id, part, parts, n, container): each piece and its container, numbered from 0.

    lengths: (doc_id, n_tokens), doc_id unique. No container holds more than its capacity; documents without tokens
    are in none. Empty input gives an empty result.
    """
    all_ = materialize(pieces(lengths, capacity))
    counts = {r["n"]: r["c"] for r in all_.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most `capacity` rows
    salts = max(1, min(4096, sum(counts.values()) // 50_000))
    limit = capacity // SMALL
    large = {n: c for n, c in counts.items() if limit < n < capacity}
    small = {n: c for n, c in counts.items() if n <= limit}
    full = counts.get(capacity, 0)
    offset, runs, used = plan_large(large, capacity, groups)
    ranked = indexed(all_, "n", "rank", ["doc_id", "part"], salts)
    ranked = materialize(ranked)
    schema = "doc_id bigint, part int, parts int, n int, container bigint"
    firsts = np.array([r[0] for r in runs], np.int64)
    bases = np.array([r[2] for r in runs], np.int64)
    offsets = np.zeros(capacity + 1, np.int64)
    for n, at in offset.items():
        offsets[n] = at

    def place_large(batches):
        for b in batches:
            rank = b["rank"].to_numpy() + offsets[b["n"].to_numpy()]
            i = np.searchsorted(firsts, rank, side="right") - 1
            b["container"] = bases[i] + rank - firsts[i] if len(b) else rank
            yield b[["doc_id", "part", "parts", "n", "container"]]

    cols = ["doc_id", "part", "parts", "n", "rank"]
    placed = materialize(ranked.where(f"n > {limit} AND n < {capacity}").select(*cols).mapInPandas(place_large, schema))
    whole = ranked.where(f"n = {capacity}").select("doc_id", "part", "parts", "n", (F.col("rank") + used).alias("container"))
    if not small:
        return placed.unionByName(whole)
    free = placed.groupBy("container").agg((F.lit(capacity) - F.sum("n")).cast("int").alias("free")).where("free > 0")
    free = materialize(indexed(free, "free", "at", ["container"], salts))
    room = {r["free"]: r["c"] for r in free.groupBy("free").agg(F.count("*").alias("c")).collect()}  # at most `capacity` rows
    fills, fresh = plan_small(room, small, capacity)
    fill = np.array(sorted(fills), np.int64).reshape(-1, 5)
    base = used + full
    span = 1 << 40
    where = fill[:, 0] * span + fill[:, 1]

    def place_small(batches):
        for b in batches:
            i = np.searchsorted(where, b["n"].to_numpy().astype(np.int64) * span + b["rank"].to_numpy(), side="right") - 1
            run = fill[i] if len(b) else np.zeros((0, 5), np.int64)
            b["free"] = run[:, 3].astype(np.int32)
            b["at"] = run[:, 4] + b["rank"].to_numpy() - run[:, 1]
            yield b[["doc_id", "part", "parts", "n", "free", "at"]]

    tiny = ranked.where(f"n <= {limit}").select(*cols).mapInPandas(place_small, "doc_id bigint, part int, parts int, n int, free int, at bigint")
    tiny = materialize(tiny)
    filled = tiny.where("free >= 0").join(free, ["free", "at"]).select(*placed.columns)
    opened = tiny.where("free < 0").select("doc_id", "part", "parts", "n", (F.col("at") + base).alias("container"))
    return placed.unionByName(whole).unionByName(filled).unionByName(opened)


def split_documents(packed: DataFrame) -> DataFrame:
    """doc_id of the documents that no single container can hold."""
    return packed.where("parts > 1").select("doc_id").distinct()
