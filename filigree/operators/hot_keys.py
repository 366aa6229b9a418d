"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Both inputs of a join are aggregated by the join key first, so the join meets one compact state per key and side, and
the joined rows are never made: counts multiply, and a side's sum is multiplied by the other side's count. What is
left is rolled up. Each first aggregate combines on the map side, so a hot key reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standing_edges(edges: DataFrame) -> DataFrame:
    """The row with the latest loaded_at of each eid (eid, src, dst, weight). Null eids are dropped; a null loaded_at
    is the oldest; ties give the greatest src, then dst, then weight."""
    last = edges.where("eid IS NOT NULL").groupBy("eid").agg(F.max(F.struct("loaded_at", "src", "dst", "weight")).alias("r"))
    return last.select("eid", "r.src", "r.dst", "r.weight")


def sound_edges(edges: DataFrame) -> DataFrame:
    """Standing rows whose ends are present and differ and whose weight is present, finite and not zero."""
    return standing_edges(edges).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND abs(weight) > 0 AND abs(weight) < double('inf')")


def neighbour_counts(sound: DataFrame) -> DataFrame:
    """(node, neighbours): distinct neighbours of every node, over both directions.

    The undirected pairs are made distinct by both ends, which no hot node can unbalance; then each end is counted on
    its own, and the two compact states of a node are joined and added.
    """
    pairs = sound.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.lit(1).alias("one"))
    low = pairs.groupBy(F.col("lo").alias("node")).agg(F.count("*").alias("n_low"))
    high = pairs.groupBy(F.col("hi").alias("node")).agg(F.count("*").alias("n_high"))
    both = low.join(high, "node", "full_outer")
    return both.select("node", (F.coalesce("n_low", F.lit(0)) + F.coalesce("n_high", F.lit(0))).alias("neighbours"))


def join_totals(
    left: DataFrame, right: DataFrame, key: str, left_value: str | None = None, right_value: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """Totals over the inner join of left and right on key, without making the joined rows.

    Result per `by` (columns of right; default the key): pairs = joined rows, left_sum and right_sum = sums of the
    value columns over them (only for the values named). Null keys join nothing; null values count as rows and add
    nothing; a group all of whose values are null has a null sum. Columns of the sides may clash: only those named
    are read.
    """
    by = by or [key]
    kept = [key, *(c for c in by if c != key)]

    def state(side: DataFrame, keys: list[str], value: str | None, p: str) -> DataFrame:
        cols = [*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)), *([F.col(value).cast("double").alias("_v")] if value else [])]
        rows = side.where(F.col(key).isNotNull()).select(*cols).groupBy(*(f"_g{i}" for i in range(len(keys))))
        return rows.agg(F.count("*").alias(f"{p}_n"), *([F.sum("_v").alias(f"{p}_s")] if value else []))

    a, b = state(left, [key], left_value, "l"), state(right, kept, right_value, "r")
    totals = [F.sum(F.col("l_n") * F.col("r_n")).alias("pairs")]
    if left_value:
        totals.append(F.sum(F.col("l_s") * F.col("r_n")).alias("left_sum"))
    if right_value:
        totals.append(F.sum(F.col("r_s") * F.col("l_n")).alias("right_sum"))
    groups = [F.col(f"_g{kept.index(c)}").alias(c) for c in by]
    return a.join(b, "_g0").groupBy(*groups).agg(*totals)
