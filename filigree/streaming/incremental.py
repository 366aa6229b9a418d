"""New items into an existing embedding: each arriving batch is tied to its nearest stored items and solved with those
pinned. An extension; the embedding that is there does not move."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions import kernels as K
from filigree.operators.knn import _blocks, _tiles, _top, BLOCK, PAIR
from filigree.plans.constraints import Anchored
from filigree.plans.solver import LocalObjective, minimize
from filigree.session import materialize


def nearest_stored(batch: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance, rank): for each batch item (id, x) its k nearest stored items, exact, by block tiles."""

    def packed(rows, name):
        parts = max(1, -(-rows.count() // BLOCK))
        t = _blocks(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts))), ["block"])
        return t.select(F.col("block").alias(name), F.col("ids").alias(f"{name}_ids"), F.col("x").alias(f"{name}_x"))

    tiles = packed(batch, "a").crossJoin(packed(stored, "b"))  # every batch block meets every stored block
    return _top(tiles.select("a", "b", "a_ids", "a_x", "b_ids", "b_x").mapInPandas(lambda t: _tiles(t, k, False), PAIR), k)


def place(batch: DataFrame, stored: DataFrame, embedding: DataFrame, k: int = 5, kernel: K.Kernel | None = None, max_iter: int = 100) -> DataFrame:
    """(id, x): positions of the batch items. Stored neighbours keep theirs; each new item starts at the mean of its
    neighbours' places. A batch must fit the driver, which a micro-batch does by its source's limits."""
    near = materialize(nearest_stored(batch, stored, k))
    at = embedding.select(F.col("id").alias("dst"), F.col("x").alias("y"))
    rows = near.join(at, "dst").select("src", "dst", "y").orderBy("src", "dst").toPandas()
    spark = batch.sparkSession
    if not len(rows):
        return spark.createDataFrame([], "id bigint, x array<double>")
    new, old = rows["src"].unique(), rows["dst"].unique()
    index = {v: i for i, v in enumerate(new)}
    pin = {v: len(new) + i for i, v in enumerate(old)}
    src = rows["src"].map(index).to_numpy()
    dst = rows["dst"].map(pin).to_numpy()
    y = np.stack(rows["y"].to_numpy())
    x = np.zeros((len(new) + len(old), y.shape[1]))
    np.add.at(x, src, y)
    x[: len(new)] /= np.bincount(src, minlength=len(new))[: len(new), None]
    x[dst] = y
    constraint = Anchored(np.arange(len(new), len(x)), x[len(new) :])
    x, _ = minimize(LocalObjective(src, dst, np.ones(len(src)), kernel or K.quadratic()), constraint, x, max_iter=max_iter)
    return spark.createDataFrame([(int(v), x[i].tolist()) for v, i in index.items()], "id bigint, x array<double>")


def stream(source: DataFrame, stored: DataFrame, embedding: DataFrame, path: str, checkpoint: str, k: int = 5, grow: bool = False):
    """A streaming query that places each micro-batch of source (id, x) and writes it to path, one folder an epoch, so a
    batch that is run again replaces its rows. With grow, items placed by earlier epochs are stored items to later ones.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark, have, at = batch.sparkSession, stored, embedding
        if grow and epoch:
            try:
                old = spark.read.schema("id bigint, x array<double>, features array<double>, epoch bigint").parquet(path).where(F.col("epoch") < epoch)
                have, at = have.unionByName(old.select("id", F.col("features").alias("x"))), at.unionByName(old.select("id", "x"))
            except AnalysisException:  # nothing was placed so far
                pass
        rows = materialize(batch.select("id", "x"))
        placed = place(rows, have, at, k).join(rows.withColumnRenamed("x", "features"), "id")
        placed.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
