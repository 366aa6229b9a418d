"""What to look at after a solve: worst and best pairs, distribution of distortions, codes and frames for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.pairs import numbered
from filigree.session import materialize


def extreme_pairs(distorted: DataFrame, count: int | None = None, highest: bool = True) -> DataFrame:
    """Pairs by distortion, ties by src and dst; count makes it a top-k."""
    order = [F.col("distortion").desc() if highest else F.col("distortion").asc(), "src", "dst"]
    ordered = distorted.orderBy(*order)
    return ordered if count is None else ordered.limit(count)


def cdf(distorted: DataFrame, column: str = "distortion", max_points: int = 100_000) -> DataFrame:
    """(value, share): the empirical distribution, thinned to about max_points steps; the last point stays.

    Ranks come from a range partition each: rows are cut into value ranges by approximate quantiles and a range's
    offset is added, so no single task sorts everything. Rows with the same value are ranked by src and dst.
    """
    rows = materialize(distorted.select("src", "dst", F.col(column).alias("value")).where("value IS NOT NULL"))
    cuts = rows.approxQuantile("value", [k / 64 for k in range(1, 64)], 0.005)
    if not cuts:
        return rows.select("value", F.lit(0.0).alias("share"))
    bucket = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col("value")))
    # equal values may be very many: they are parted by their src as well
    parted = rows.withColumn("_b", bucket).withColumn("_s", F.when(F.col("value").isin(cuts), F.shiftright("src", 12)).otherwise(F.lit(-(1 << 62))))
    counts = parted.groupBy("_b", "_s").agg(F.count("*").alias("n"), F.min("value").alias("lo"))
    before = Window.orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_b", "_s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    total = rows.count()
    step = max(1, int(total / max_points))
    local = F.row_number().over(Window.partitionBy("_b", "_s").orderBy("value", "src", "dst"))
    ranked = parted.withColumn("_r", local).join(counts, ["_b", "_s"]).withColumn("rank", F.col("_r") + F.col("_from"))
    kept = ranked.where(((F.col("rank") - 1) % step == 0) | (F.col("rank") == total))
    return kept.select("value", (F.col("rank") / total).alias("share"))


def label_codes(rows: DataFrame, column: str) -> DataFrame:
    """rows plus code: the place of the value among the sorted distinct values, from 0. The distinct values are
    numbered, not the rows; null values have a null code."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    codes = numbered(values, "_v").select("_v", F.col("idx").cast("int").alias("code"))
    return rows.join(codes, F.col(column) == F.col("_v"), "left").drop("_v")


def plot_frame(embedding: DataFrame, attributes: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Points (id, x1, x2, x3, attributes) of the first three coordinates, missing ones 0, and segments of the edges."""
    at = [F.coalesce(F.get(F.col("x"), F.lit(k)), F.lit(0.0)).alias(f"x{k + 1}") for k in range(3)]
    points = embedding.select("id", *at)
    if attributes is not None:
        points = points.join(attributes, "id", "left")
    if edges is None:
        return points, None
    p = embedding.select("id", *at)
    ends = lambda s: p.select(F.col("id").alias(s), *(F.col(f"x{k}").alias(f"{s}_x{k}") for k in (1, 2, 3)))
    return points, edges.select("src", "dst").join(ends("src"), "src").join(ends("dst"), "dst")
