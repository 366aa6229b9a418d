"""Readers of array files, and writers of results.

Arrays of one row per item become (id, x). Large .npy matrices are read by row ranges on the executors (the file must
be reachable from them); nothing pickled is ever loaded.
"""

from __future__ import annotations

import gzip
import struct
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators.graph import Graph
from filigree.operators.pairs import numbered

ROWS_PER_TASK = 50_000


@dataclass
class Dataset:
    """data: items or a Graph; attributes: name to (id, value) table."""

    data: DataFrame | Graph
    attributes: dict[str, DataFrame] = field(default_factory=dict)
    other_data: dict[str, object] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def attribute(self) -> DataFrame | None:
        """The attribute, if there is exactly one."""
        return next(iter(self.attributes.values())) if len(self.attributes) == 1 else None


def need(*paths: str) -> None:
    missing = [p for p in paths if not Path(p).exists()]
    if missing:
        raise FileNotFoundError(f"not there, and there is no network to fetch them: {missing}")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) of a .npy matrix, or (id, value) of a vector."""
    need(path)
    head = np.load(path, mmap_mode="r", allow_pickle=False)
    n, flat = head.shape[0], head.ndim == 1
    text = head.dtype.kind in "US"
    starts = spark.range(0, n, ROWS_PER_TASK)
    kind = "value string" if text else "value double" if flat else "x array<double>"

    def load(batches):
        a = np.load(path, mmap_mode="r", allow_pickle=False)
        for b in batches:
            for s in b["id"]:
                part = np.asarray(a[s : s + ROWS_PER_TASK])
                ids = np.arange(s, s + len(part))
                if flat:
                    yield pd.DataFrame({"id": ids, "value": part.astype(str) if text else part.astype(float)})
                else:
                    yield pd.DataFrame({"id": ids, "x": list(part.reshape(len(part), -1).astype(float))})

    return starts.mapInPandas(load, f"id bigint, {kind}")


def read_npz_graph(spark: SparkSession, path: str) -> Graph:
    """A graph from a compressed sparse-row matrix in .npz (arrays data, indices, indptr, shape)."""
    need(path)
    with np.load(path, allow_pickle=False) as z:
        data, indices, indptr, shape = z["data"], z["indices"], z["indptr"], z["shape"]
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    up = (rows < indices) & (data != 0) & np.isfinite(data)
    if ((rows == indices) & (data != 0)).any():
        raise ValueError("the diagonal must be zero")
    table = pd.DataFrame({"src": rows[up].astype(np.int64), "dst": indices[up].astype(np.int64), "weight": data[up].astype(float)})
    return Graph(spark.createDataFrame(table, "src bigint, dst bigint, weight double"), int(shape[0]))


def _frame(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """(id, x) of a matrix or (id, value) of a vector, by Arrow."""
    a = np.asarray(a, float)
    ids = pa.array(np.arange(len(a)), pa.int64())
    if a.ndim == 1:
        return spark.createDataFrame(pa.table({"id": ids, "value": a}))
    flat = a.reshape(len(a), -1)
    ends = pa.array(np.arange(len(a) + 1) * flat.shape[1], pa.int32())
    return spark.createDataFrame(pa.table({"id": ids, "x": pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))}))


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) of an IDX image file, or (id, value) of an IDX label file; .gz as well."""
    need(path)
    raw = (gzip.open if path.endswith(".gz") else open)(path, "rb").read()
    zero, kind, dims = struct.unpack(">HBB", raw[:4])
    types = {8: np.uint8, 9: np.int8, 11: np.dtype(">i2"), 12: np.dtype(">i4"), 13: np.dtype(">f4"), 14: np.dtype(">f8")}
    if zero or kind not in types:
        raise ValueError("not an IDX file")
    shape = struct.unpack(f">{dims}I", raw[4 : 4 + 4 * dims])
    a = np.frombuffer(raw, types[kind], offset=4 + 4 * dims).reshape(shape).astype(float)
    return _frame(spark, a)


def read_csv_matrix(spark: SparkSession, path: str, columns: list[str] | None = None, id_column: str | None = None) -> DataFrame:
    """(id, x) of the numeric columns of a CSV with a header; columns that are no number are null there. Without an id
    column, ids are 0..n-1 in the order of the file."""
    table = spark.read.csv(path, header=True, inferSchema=True)
    columns = columns or [c for c, t in table.dtypes if t in ("int", "bigint", "double", "float") and c != id_column]
    x = F.array(*(F.col(c).cast("double") for c in columns)).alias("x")
    if id_column:
        return table.select(F.col(id_column).cast("bigint").alias("id"), x)
    return numbered(table.select(F.monotonically_increasing_id().alias("_at"), x), "_at").select(F.col("idx").alias("id"), "x")


def dense_matrix(spark: SparkSession, array: np.ndarray) -> DataFrame:
    a = np.asarray(array)
    if a.dtype.kind not in "fiub":
        raise ValueError("numbers expected")
    return _frame(spark, a)


def sparse_matrix(rows: DataFrame, n_features: int) -> DataFrame:
    """(id, x) from (id, indices, values): dense rows by a lookup in place."""
    entry = F.map_from_arrays("indices", "values")
    return rows.withColumn("_m", entry).select("id", F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda k: F.coalesce(F.col("_m")[k], F.lit(0.0))).alias("x"))


def images(spark: SparkSession, folder: str, name: str, label: str) -> Dataset:
    """Images and labels in IDX files: train and t10k parts stacked."""
    parts = [(f"{folder}/{p}-images-idx3-ubyte.gz", f"{folder}/{p}-labels-idx1-ubyte.gz") for p in ("train", "t10k")]
    need(*(f for p in parts for f in p))
    x, y = [read_idx(spark, a) for a, _ in parts], [read_idx(spark, b) for _, b in parts]
    first = x[0].count()
    move = lambda t: t.withColumn("id", F.col("id") + first)
    return Dataset(x[0].unionByName(move(x[1])), {label: y[0].unionByName(move(y[1]))}, metadata={"name": name})


def graph_dataset(spark: SparkSession, npz: str, attributes: dict[str, str], name: str) -> Dataset:
    """A graph in .npz with attributes in .npy files."""
    return Dataset(read_npz_graph(spark, npz), {k: read_npy(spark, p) for k, p in attributes.items()}, metadata={"name": name})


def matrix_dataset(spark: SparkSession, path: str, attributes: dict[str, str], name: str) -> Dataset:
    """A matrix in .npy or .csv with attributes in .npy or .csv files."""
    data = read_npy(spark, path) if path.endswith(".npy") else read_csv_matrix(spark, path)
    load = lambda p: read_npy(spark, p) if p.endswith(".npy") else read_csv_attribute(spark, p)
    return Dataset(data, {k: load(p) for k, p in attributes.items()}, metadata={"name": name})


def mnist(spark: SparkSession, root: str) -> Dataset:
    return images(spark, f"{root}/MNIST/raw", "mnist", "digits")


def fashion_mnist(spark: SparkSession, root: str) -> Dataset:
    return images(spark, f"{root}/FashionMNIST/raw", "fashion_mnist", "class")


def google_scholar(spark: SparkSession, root: str, full: bool = False) -> Dataset:
    """Co-author graph. Tables beside it must be Parquet, as pickles are not loaded: scholar_df with column
    coauthors_pct in the order of the nodes, and, unless full, scholar_disciplines_df."""
    at = f"{root}/scholar"
    names = ["scholar_df", *([] if full else ["scholar_disciplines_df"])]
    need(f"{at}/scholar_graph.npz", *(f"{at}/{n}.parquet" for n in names))
    tables = {n: spark.read.parquet(f"{at}/{n}.parquet") for n in names}
    people = numbered(tables["scholar_df"].withColumn("_at", F.monotonically_increasing_id()), "_at")
    other = {} if full else {"dataframe": tables["scholar_df"], "disciplines": tables["scholar_disciplines_df"]}
    coauthors = people.select(F.col("idx").alias("id"), F.col("coauthors_pct").alias("value"))
    return Dataset(read_npz_graph(spark, f"{at}/scholar_graph.npz"), {"coauthors": coauthors}, other, {"name": "google_scholar"})


def google_scholar_interests(spark: SparkSession, root: str) -> Dataset:
    """Graph of topics by co-occurrence; interests as .npy, as pickles are not loaded."""
    return graph_dataset(spark, f"{root}/interests/topic_cooccurrence_matrix.npz", {"interests": f"{root}/interests/interests.npy"}, "google_scholar_interests")


def covid19_scrna_wilk(spark: SparkSession, root: str) -> Dataset:
    at = f"{root}/scrna_covid19_wilk"
    labels = {"cell_type": f"{at}/scrna_cell_type_attr.npy", "health_status": f"{at}/scrna_health_status_attr.npy"}
    return matrix_dataset(spark, f"{at}/scrna_data_matrix.npy", labels, "covid19_scrna_wilk")


def population_genetics(spark: SparkSession, root: str) -> Dataset:
    """The clean rows, their colours and those of the corrupted rows, which are in other_data."""
    at = f"{root}/population_genetics"
    need(*(f"{at}/{n}.csv" for n in ("data", "corrupted_data", "data_colors", "corrupted_colors")))
    colours = {"clean_colors": f"{at}/data_colors.csv", "corrupted_colors": f"{at}/corrupted_colors.csv"}
    out = matrix_dataset(spark, f"{at}/data.csv", colours, "population_genetics")
    out.other_data["corrupted_data"] = read_csv_matrix(spark, f"{at}/corrupted_data.csv")
    return out


def counties(spark: SparkSession, root: str) -> Dataset:
    """County features and the share of a party; the tables they were made from are in other_data."""
    at = f"{root}/counties"
    tables = {"county_dataframe": f"{at}/acs2017_county_data.csv", "voting_dataframe": f"{at}/2016_US_County_Level_Presidential_Results.csv"}
    need(f"{at}/county_data.npy", f"{at}/democratic_fraction.npy", *tables.values())
    out = matrix_dataset(spark, f"{at}/county_data.npy", {"democratic_fraction": f"{at}/democratic_fraction.npy"}, "counties")
    out.other_data.update({k: spark.read.csv(p, header=True, inferSchema=True) for k, p in tables.items()})
    return out


def read_csv_attribute(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of a CSV with a header: its one column, or an array of all."""
    table = spark.read.csv(path, header=True, inferSchema=True)
    value = F.col(table.columns[0]) if len(table.columns) == 1 else F.array(*(F.col(c) for c in table.columns))
    return numbered(table.select(F.monotonically_increasing_id().alias("_at"), value.alias("value")), "_at").select(F.col("idx").alias("id"), "value")


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.format(kind).save(path)


def _pyplot():
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("matplotlib is not installed; use the plot frame") from e
    return plt


def render(points: DataFrame, path: str, color: str | None = None, limit: int = 200_000, edges: DataFrame | None = None, axis_limits: tuple[float, float] | None = None, three: bool = False) -> None:
    """A scatter plot of a plot frame, where matplotlib is there; at most `limit` points, by hash. color: a column of
    labels, numbers or (red, green, blue, alpha) arrays; edges: segments of the plot frame, drawn below the points."""
    plt = _pyplot()
    rows = points.orderBy(F.xxhash64("id")).limit(limit).toPandas()
    axes = ["x1", "x2", "x3"][: 3 if three else 2]
    ax = plt.figure().add_subplot(projection="3d" if three else None)
    if edges is not None:
        for r in edges.limit(limit).toPandas().itertuples(index=False):
            ax.plot(*([getattr(r, f"src_{c}"), getattr(r, f"dst_{c}")] for c in axes), color="grey", linewidth=0.2)
    shade = None
    if color:
        first = rows[color].iloc[0] if len(rows) else 0
        shade = np.stack(rows[color].to_numpy()) if np.ndim(first) else rows[color] if isinstance(first, float) else pd.factorize(rows[color])[0]
    ax.scatter(*(rows[c] for c in axes), s=1, c=shade)
    if axis_limits:
        ax.set(xlim=axis_limits, ylim=axis_limits)
    ax.figure.savefig(path)
    plt.close(ax.figure)


def film(snapshots: DataFrame, folder: str, every: int = 1, limit: int = 200_000) -> list[str]:
    """Pictures of a solve's snapshots (iter, id, x), one an iteration, all with the same limits; returns their paths."""
    steps = sorted(r[0] for r in snapshots.select("iter").distinct().collect())[::every]
    top = snapshots.select(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 1.0
    paths = []
    for k in steps:
        at = snapshots.where(F.col("iter") == k).select("id", F.get("x", F.lit(0)).alias("x1"), F.coalesce(F.get("x", F.lit(1)), F.lit(0.0)).alias("x2"))
        paths.append(f"{folder}/{k:06d}.png")
        render(at, paths[-1], limit=limit, axis_limits=(-top, top))
    return paths
