"""A weighted undirected graph as an edge table (src, dst, weight), src < dst, one row per pair, weight not zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators.pairs import n_pairs


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    n_items: int

    @staticmethod
    def from_edges(edges: DataFrame, n_items: int | None = None) -> Graph:
        """Ends are put in order, weights default to 1, repeated pairs are summed; sums of zero, infinities and what is
        not a number are no edges. A self edge other than zero raises ValueError.

        Null ends are dropped; null weights add nothing. n_items: the greatest id of any edge plus 1 if not given.
        """
        w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        rows = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("weight"))
        loops, last = rows.agg(F.max(F.when((F.col("src") == F.col("dst")) & (F.col("weight") != 0), F.col("src"))), F.max("dst")).first()
        if loops is not None:
            raise ValueError(f"a self edge at {loops}")
        summed = rows.where("src < dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight <> 0 AND abs(weight) < double('inf')")
        return Graph(summed, (-1 if last is None else last) + 1 if n_items is None else n_items)

    @staticmethod
    def from_adjacency(rows: DataFrame) -> Graph:
        """rows: (id, features), features the dense row of item id. Zeros and infinities are no edges, the lower
        triangle is not read, and a diagonal entry other than zero raises ValueError."""
        cells = rows.select(F.col("id").alias("src"), F.posexplode("features").alias("dst", "weight"))
        if cells.where("src = dst AND weight <> 0").limit(1).count():
            raise ValueError("the diagonal must be zero")
        kept = cells.where("src < dst AND weight <> 0 AND abs(weight) < double('inf')")
        return Graph(kept.select("src", F.col("dst").cast("bigint").alias("dst"), F.col("weight").cast("double").alias("weight")), rows.count())

    @staticmethod
    def empty(spark: SparkSession, n_items: int = 0) -> Graph:
        return Graph(spark.createDataFrame([], "src bigint, dst bigint, weight double"), n_items)

    def symmetric(self) -> DataFrame:
        """Both directions of every edge."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return self.edges.select("src", "dst", "weight").unionByName(back)

    def neighbours(self, node: int) -> DataFrame:
        """(neighbour, distance) of one node; the filter reaches the scan of both directions."""
        there = self.edges.where(F.col("src") == node).select(F.col("dst").alias("neighbour"), F.col("weight").alias("distance"))
        return there.unionByName(self.edges.where(F.col("dst") == node).select(F.col("src").alias("neighbour"), F.col("weight").alias("distance")))

    def weight(self, i: int, j: int) -> float:
        row = self.edges.where((F.col("src") == min(i, j)) & (F.col("dst") == max(i, j))).select("weight").first()
        return row[0] if row else 0.0

    def degrees(self) -> DataFrame:
        """(id, degree, strength): number and sum of weights of the edges at a node, of nodes with any."""
        return self.symmetric().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))

    def laplacian(self) -> DataFrame:
        """(row, col, value) of degree matrix minus adjacency, without zeros."""
        off = self.symmetric().select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.col("weight")).alias("value"))
        return off.unionByName(self.degrees().select(F.col("id").alias("row"), F.col("id").alias("col"), F.col("strength").alias("value")))

    def n_edges(self) -> int:
        return self.edges.count()

    def n_all_edges(self) -> int:
        return n_pairs(self.n_items)

    def density(self) -> float:
        return self.n_edges() / self.n_all_edges() if self.n_all_edges() else 0.0

    def scaled(self, natural_length: float) -> Graph:
        """Weights times the factor that makes their root mean square natural_length."""
        return Graph(scale(self.edges, "weight", natural_length), self.n_items)


def rms(rows: DataFrame, column: str) -> DataFrame:
    """One row: the root mean square of a column (null for no rows)."""
    return rows.agg(F.sqrt(F.avg(F.col(column) * F.col(column))).alias("rms"))


def scale(rows: DataFrame, column: str, natural_length: float) -> DataFrame:
    """rows with column times natural_length over its root mean square; the single-row aggregate is broadcast."""
    one = rms(rows, column)
    return rows.join(F.broadcast(one)).withColumn(column, F.col(column) * natural_length / F.col("rms")).drop("rms")


def radius(graph_edges: DataFrame, column: str = "weight", share: float = 0.75, times: float = 3.0) -> DataFrame:
    """One row: times the exact, linearly interpolated percentile of a column."""
    return graph_edges.agg((F.percentile(column, F.lit(share)) * times).alias("radius"))


def above(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges whose weight exceeds threshold."""
    return edges.where(F.col("weight") > threshold)


def incidence(edges: DataFrame) -> DataFrame:
    """(id, src, dst, sign): two rows per edge, 1 at its first end and -1 at its second, as in an incidence matrix."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("sign")), F.struct(F.col("dst").alias("id"), F.lit(-1).alias("sign")))).alias("e")
    return edges.select("src", "dst", ends).select("e.id", "src", "dst", "e.sign")
