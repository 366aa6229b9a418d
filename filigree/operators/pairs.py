"""Pairs of items: all, decoded, sampled, canonical."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.session import materialize

BUCKETS = 4096


def n_pairs(n: int) -> int:
    return n * (n - 1) // 2


def decode(e: Column, n: int) -> tuple[Column, Column]:
    """Item numbers (u, v) of pair number e in row-major upper-triangle order. The float root may be off by one for
    very many items, so u is put right by whole numbers. Above 1.5e9 items the numbers would not fit a BIGINT."""
    if n > 1_500_000_000:
        raise ValueError("at most 1.5e9 items")
    e = e.cast("bigint")
    first = F.floor((2 * n - 1 - F.sqrt(((2 * n - 1) * (2 * n - 1) - 8 * e).cast("double"))) / 2).cast("bigint")
    begin = lambda u: F.shiftright(u * (F.lit(2 * n - 1).cast("bigint") - u), 1)
    u = F.when(begin(first) > e, first - 1).when(begin(first + 1) <= e, first + 1).otherwise(first)
    return u.cast("bigint"), (e - begin(u) + u + 1).cast("bigint")


def all_pairs(spark: SparkSession, n: int) -> DataFrame:
    """(src, dst), src < dst, of items 0..n-1: a range decoded in place, so there is no join and no shuffle."""
    if n < 0:
        raise ValueError("n must not be negative")
    u, v = decode(F.col("id"), n)
    return spark.range(n_pairs(n)).select(u.alias("src"), v.alias("dst"))


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with src <= dst. Rows with a null end are dropped."""
    return edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def complement(spark: SparkSession, n: int, edges: DataFrame) -> DataFrame:
    """All pairs of 0..n-1 that are not in edges."""
    return all_pairs(spark, n).join(canonical(edges), ["src", "dst"], "left_anti")


def _number(text: Column) -> Column:
    """A number below 2**60 from the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def n_draws(count: int, total: int) -> int:
    """How many draws with replacement give at least count distinct ones of total, with a wide margin."""
    share = min(count / total, 0.75)
    return math.ceil(-total * math.log1p(-share) * 1.1 + 8 * math.sqrt(count) + 64)


def first_rows(rows: DataFrame, key: str, count: int, span: int, ties: list[str]) -> DataFrame:
    """The `count` rows of smallest key (0..span-1), ties by `ties`: a histogram of BUCKETS key ranges tells which range
    the last row is in, so only that range is sorted. rows is read twice and should be a table."""
    ranged = rows.withColumn("_b", F.floor(F.col(key) / (span / BUCKETS)).cast("int"))
    upto = 0
    for b, n in sorted(tuple(r) for r in ranged.groupBy("_b").count().collect()):  # at most BUCKETS + 1 rows
        if upto + n >= count:
            last = ranged.where(F.col("_b") == b).orderBy(key, *ties).limit(count - upto)
            return ranged.where(F.col("_b") < b).unionByName(last).drop("_b")
        upto += n
    return rows


def sample_edges(spark: SparkSession, n: int, count: int, exclude: DataFrame | None = None, seed: int = 0, exact: bool = False) -> DataFrame:
    """A uniform sample of `count` pairs without replacement, without the excluded.

    Raises ValueError if there are not so many pairs. Pair numbers are drawn by hash and made distinct, so the work
    goes with count, not with the number of pairs; only where more than half of all pairs are asked or a fifth are
    excluded are all pairs gone through. If exact is false and little is excluded, the excluded are dropped after
    sampling, so fewer may come out, as in rejection sampling.
    """
    gone = canonical(exclude).where("src <> dst") if exclude is not None else None
    out = gone.count() if gone is not None else 0
    total = n_pairs(n)
    if count > total - out:
        raise ValueError(f"{count} pairs asked, {total - out} there")
    if count <= 0:
        return all_pairs(spark, n).limit(0)
    dense = out >= 0.2 * total or count > 0.5 * (total - out)
    if dense:
        pool = all_pairs(spark, n)
        if gone is not None:
            pool = pool.join(gone, ["src", "dst"], "left_anti")
        drawn = materialize(pool.withColumn("_key", _number(F.concat_ws("-", "src", "dst", F.lit(str(seed))))))
        return first_rows(drawn, "_key", count, 1 << 60, ["src", "dst"]).select("src", "dst")
    late = gone is not None and not exact
    many = count if gone is None or late else math.ceil(count * total / (total - out) * 1.05) + 64
    times = n_draws(many, total)
    draws = spark.range(times).select("id", (_number(F.concat_ws("-", "id", F.lit(str(seed)))) % total).alias("e"))
    first = draws.groupBy("e").agg(F.min("id").alias("id"))
    u, v = decode(F.col("e"), n)
    pairs = first.select("id", u.alias("src"), v.alias("dst"))
    if gone is not None and exact:
        pairs = pairs.join(gone, ["src", "dst"], "left_anti")
    picked = first_rows(materialize(pairs), "id", count, times, []).select("src", "dst")
    return picked.join(gone, ["src", "dst"], "left_anti") if late else picked


def dissimilar_edges(spark: SparkSession, n: int, similar: DataFrame, count: int | None = None, seed: int = 0) -> DataFrame:
    """Pairs sampled from the complement of similar; by default as many as similar has, or all that are left."""
    have = canonical(similar).count()
    count = min(have, n_pairs(n) - have) if count is None else count
    return sample_edges(spark, n, count, similar, seed, exact=True)


def without_anchored(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """edges without those whose both ends are anchored: one semi-join marks edges, whatever the number of anchors."""
    pinned = anchors.where("id IS NOT NULL").select("id").distinct()
    a = pinned.select(F.col("id").alias("src"), F.lit(True).alias("_a"))
    b = pinned.select(F.col("id").alias("dst"), F.lit(True).alias("_b"))
    both = edges.join(a, "src", "left").join(b, "dst", "left").where("_a IS NULL OR _b IS NULL")
    return both.select(*edges.columns)


def numbered(rows: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """rows plus their number, 0..n-1 in the order of key: partition counts give offsets, so no task sorts all."""
    ranged = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    fixed = materialize(ranged)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = fixed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return fixed.withColumn("_r", local).join(offsets, "_p").withColumn(name, F.col("_r") + F.col("_from")).drop("_p", "_r", "_from")
