"""Connected components by minimum labels, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.session import materialize, release


def min_labels(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every end of a link; label is the smallest node of its component.

    Each round turns the links into stars twice: round every node its larger neighbours are tied to its smallest
    neighbour, then its smaller ones are (the two halves shrink long chains by about half a round). Every aggregate
    combines before its shuffle; a node with very many links is split by AQE's skew join. Rounds end when all links
    are stars, which no further round can change: every larger end has one link, to a node that is no larger end. Links with a null end and self links add nothing; repeated links count once; without links the
    result is empty.

    max_rounds is a guard against a fault only: the number of rounds grows as the logarithm of the longest chain,
    and running into it raises.
    """
    now = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    for _ in range(max_rounds):
        ends = now.groupBy("u").agg(F.count("*").alias("n"))
        loose = ends.where("n > 1").select("u").union(now.select("v").join(ends, F.col("v") == F.col("u"), "left_semi"))
        if not loose.limit(1).count():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(now, large)
        now = new
    else:
        raise RuntimeError("labels did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
